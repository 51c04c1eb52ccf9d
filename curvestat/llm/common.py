"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular expression.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    The files of a checkpoint go with its last reference where the session has
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="curvestat-")


def repeated(rows: DataFrame, times: str, name: str, most: int | None = None) -> DataFrame:
    """Each row as often as its column ``times`` says, numbered from 0 in ``name``.

    Rows that occur more than RUN times are dealt over the tasks in runs first. most: the
    largest number of times, where it is known; else rows are looked through for it.
    """
    numbers = lambda begin, n: F.explode(F.sequence(begin, begin + n - 1))
    zero, n = F.lit(0).cast("bigint"), F.col(times).cast("bigint")
    out = rows.filter((n > 0) & (n <= RUN)).withColumn(name, numbers(zero, n))
    often = rows.filter(n > RUN)
    if often.isEmpty() if most is None else most <= RUN:
        return out
    (run,) = fresh(out, "run")
    runs = often.withColumn(run, numbers(zero, F.ceil(n / RUN))).repartition(run)
    return out.unionByName(runs.withColumn(name, numbers(F.col(run) * RUN, F.least(F.lit(RUN), n - F.col(run) * RUN))).drop(run))


#: Rows that one task makes of one row.
RUN = 20_000


def few(rows: DataFrame, most: int) -> DataFrame:
    """A narrow table for a join: broadcast where it was counted and has at most ``most`` rows, shuffled beyond it."""
    return F.broadcast(rows) if rows.count() <= most else rows


def words(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; null counts as no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        out.append(stem)
    return out


def let(value: Column, body) -> Column:
    """Evaluate value once and use it in body, whatever the optimiser inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
