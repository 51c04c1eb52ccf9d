"""Sinks: CSV in two dialects, curve tables, summaries, inventories."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvestat.functions.arrays import digest
from curvestat.sources.coordinates import file_hashes


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite")


MARK = "\ufeff"


def write_csv_rounded(df: DataFrame, path: str, digits: int = 12) -> None:
    """CSV whose doubles have so many significant digits; each file begins with a byte-order mark."""
    text = [F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}g", c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    marked = df.select(*text)
    marked = marked.withColumnRenamed(marked.columns[0], MARK + marked.columns[0])
    marked.write.csv(path, header=True, mode="overwrite", encoding="UTF-8")


def write_curves(df: DataFrame, path: str) -> DataFrame:
    """Curves by waveform; returns each waveform's curves and digest."""
    df.write.partitionBy("waveform").parquet(path, mode="overwrite")
    return cube_digest(df.sparkSession.read.parquet(path))


def cube_digest(curves: DataFrame) -> DataFrame:
    """waveform, curves and sha256 over the digests of all curves in the order of participant, action and trial."""
    order = ("participant", "action", "trial")
    one = curves.select("waveform", *order, digest(F.col("y")).alias("d"))
    return one.groupBy("waveform").agg(F.count("*").alias("curves"), F.sort_array(F.collect_list(F.struct(*order, "d"))).alias("all")).select("waveform", "curves", F.sha2(F.array_join("all.d", "").cast("binary"), 256).alias("sha256"))


def summary(df: DataFrame) -> dict:
    """The one row of a summary query as a dict."""
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    return rows[0].asDict(recursive=True)


def write_summary(df: DataFrame, path: str) -> None:
    Path(path).write_text(json.dumps(summary(df), indent=2, default=str), encoding="utf-8")


def inventory(spark: SparkSession, path: str, exclude: str | None = None) -> DataFrame:
    """Path below the given one, bytes and SHA-256 of each file, sorted; exclude: a regular expression."""
    root = path.rstrip("/").rsplit(":", 1)[-1].lstrip("/")
    below = F.substring_index("path", f"/{root}/", -1)
    files = file_hashes(spark, path).select(below.alias("path"), "bytes", "sha256")
    return (files if exclude is None else files.filter(~F.col("path").rlike(exclude))).orderBy("path")


def provenance(spark: SparkSession, roles: dict[str, str]) -> DataFrame:
    """role, path, bytes, sha256 of the files behind each role."""
    out = None
    for role, path in roles.items():
        rows = file_hashes(spark, path).select(F.lit(role).alias("role"), "path", "bytes", "sha256")
        out = rows if out is None else out.unionByName(rows)
    return out


def alias(df: DataFrame, name: str) -> DataFrame:
    """A table under a second name in the session, without moving data."""
    df.createOrReplaceTempView(name)
    return df


def second_name(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A Parquet table under a second path; stores have no links, so its files are written again."""
    spark.read.parquet(path).write.parquet(target, mode="overwrite")
    return spark.read.parquet(target)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in a folder that the cluster shares: that of checkpoints, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that ``scratch`` named."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
