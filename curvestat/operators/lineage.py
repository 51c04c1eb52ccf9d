"""Cutting lineage between the rounds of iterative operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted table is broadcast.
MOST_BROADCAST = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="curvestat-")


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint, which outlives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def few(rows: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A narrow table for a join: broadcast where it was counted and is small, shuffled beyond that."""
    return F.broadcast(rows) if rows.count() <= most else rows
