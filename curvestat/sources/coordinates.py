"""Sources: coordinate files, their names and hashes; curve tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvestat import schema
from curvestat.functions import arrays

#: A trial's file name is prefix_120_index_action_code_200_rawlength.csv.
NAME = r"^(?:{prefix})_120_(\d+)_(\d+)_(\d+)_200_(\d+)\.csv$"
RACKET, BODY = "bat", "human"
ROWS = 200


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, md5 and sha256 of each file below a path (recursive)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def verify_archive(spark: SparkSession, path: str, size: int, md5: str, sha256: str) -> None:
    """Refuse an archive unless size and both digests match."""
    found = file_hashes(spark, path).first()
    if found is None or (found["bytes"], found["md5"], found["sha256"]) != (size, md5, sha256):
        raise ValueError(f"{path} isn't the expected archive")


def located(spark: SparkSession, path: str, folders: dict[str, int]) -> str:
    """The one folder below a path that holds all the named folders with so many CSV files each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path).select("path")
    parts = F.split("path", "/")
    counted = files.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), "/").alias("root"), F.element_at(parts, -2).alias("folder")).groupBy("root", "folder").agg(F.count("*").alias("n"))
    good = [F.bool_or((F.col("folder") == k) & (F.col("n") == n)) for k, n in folders.items()]
    found = counted.groupBy("root").agg(*[g.alias(f"ok{i}") for i, g in enumerate(good)]).filter(" AND ".join(f"ok{i}" for i in range(len(good)))).take(2)
    if len(found) != 1:
        raise ValueError(f"{len(found)} folders below {path} hold {folders}")
    return found[0]["root"]


def parse_names(files: DataFrame, name: str = "file_name", prefix: str = RACKET) -> DataFrame:
    """Columns global_index, action, participant, raw_length from file names; others are skipped."""
    pattern = NAME.format(prefix=prefix)
    part = lambda i: F.regexp_extract(name, pattern, i).cast("int")
    return files.filter(F.col(name).rlike(pattern)).select("*", part(1).alias("global_index"), part(2).alias("action"), part(3).alias("participant"), part(4).alias("raw_length"))


def list_trials(spark: SparkSession, directory: str, prefix: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory)
    return parse_names(files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name")), prefix=prefix)


def read_frames(spark: SparkSession, directory: str, prefix: str, columns: int) -> DataFrame:
    """One row per file: identity and coords, an array of frames, each an array of doubles.

    Files are read whole, so the order of rows is kept without a shuffle; a
    byte-order mark is dropped. A file of twice ROWS rows whose halves are equal
    is halved; other lengths, and values that aren't finite numbers, fail.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", "")
    lines = F.filter(F.split(text, "\\r?\\n"), lambda x: F.trim(x) != "")
    rows = F.transform(lines, lambda x: F.transform(F.split(x, ","), lambda v: F.trim(v).cast("double")))
    named = parse_names(files.select("content", F.element_at(F.split("path", "/"), -1).alias("file_name")), prefix=prefix)
    read = named.select("file_name", "global_index", "action", "participant", "raw_length", rows.alias("coords"))
    read = read.withColumn("doubled", arrays.doubled(F.col("coords"), ROWS)).withColumn("coords", arrays.halved(F.col("coords"), ROWS))
    good = (F.size("coords") == ROWS) & F.forall("coords", lambda r: (F.size(r) == columns) & arrays.all_finite(r))
    return read.withColumn("coords", F.when(good, F.col("coords")).otherwise(F.raise_error(F.concat(F.lit("malformed coordinate file: "), "file_name"))))


def observable_frames(frames: DataFrame) -> DataFrame:
    """The first min(raw_length, ROWS) frames; the padded rest must be zero."""
    short = F.forall(F.slice("coords", F.least("raw_length", F.lit(ROWS)) + 1, ROWS), lambda r: F.forall(r, lambda v: v == 0))
    kept = F.slice("coords", F.lit(1), F.least("raw_length", F.lit(ROWS)))
    return frames.withColumn("coords", F.when(short, kept).otherwise(F.raise_error(F.concat(F.lit("padding isn't zero: "), "file_name"))))


def pair_files(racket: DataFrame, body: DataFrame) -> DataFrame:
    """Racket and body files of one trial by parsed key."""
    keys = ["global_index", "action", "participant", "raw_length"]
    right = body.select(*keys, F.col("file_name").alias("body_file"))
    return racket.withColumnRenamed("file_name", "racket_file").join(right, keys)


def unpaired(racket: DataFrame, body: DataFrame) -> DataFrame:
    return racket.join(body, ["global_index", "action", "participant", "raw_length"], "left_anti")


def read_table(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema."""
    return spark.read.csv(path, header=True, schema=columns, mode="FAILFAST")


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CURVE).parquet(path)
