"""Integrity constraints: each returns the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvestat.functions.arrays import all_finite


def row_count(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).filter(F.col("rows") != expected)


def cell_counts(df: DataFrame, cell: list[str], expected: int) -> DataFrame:
    return df.groupBy(*cell).agg(F.count("*").alias("rows")).filter(F.col("rows") != expected)


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def full_product(df: DataFrame, key: list[str]) -> DataFrame:
    """All combinations of the values that each key column takes."""
    return reduce(lambda a, b: a.crossJoin(b), [df.select(k).distinct() for k in key])


def key_differences(df: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Keys missing from df, and keys that aren't expected."""
    missing = expected.select(*key).distinct().join(df, key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = df.select(*key).distinct().join(expected, key, "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def not_finite(curves: DataFrame, y: str = "y") -> DataFrame:
    return curves.filter(~all_finite(F.col(y)))


def unequal_lengths(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.filter(F.size(left) != F.size(right))


def forbidden(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows whose text holds what a release may not."""
    return df.filter(F.col(text).rlike(pattern))


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def require_empty(df: DataFrame, what: str) -> None:
    """Fail with a sample of the offending rows."""
    rows = df.take(5)
    if rows:
        raise ValueError(f"{what}: {rows}")


def require_counts(**counts: int) -> None:
    for name, n in counts.items():
        if n < 1:
            raise ValueError(f"{name} must be at least 1")
