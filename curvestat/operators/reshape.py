"""Reshaping: delimited lists, pivots over a full domain, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_lists(df: DataFrame, keys: list[str], left: str, right: str, sep: str = ";") -> DataFrame:
    """One row for each pair of items of two delimited lists; lists of unequal length fail."""
    items = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, sep))
    a, b = items(left), items(right)
    zipped = F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("l"), b.alias("r"))).otherwise(F.raise_error(F.lit("lists differ in length")))
    return df.select(*keys, F.explode(zipped).alias("z")).select(*keys, F.col("z.l").alias(left), F.col("z.r").alias(right))


def count_matrix(df: DataFrame, domain: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by row and column value, 0 where there are none, over the full domain of rows."""
    wide = df.groupBy(row).pivot(column, values).count()
    return domain.select(row).distinct().join(wide, row, "left").na.fill(0, [str(v) for v in values])


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """Number of the equal bin of x from 0; the last is closed."""
    return F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, keys: list[str], x: str, low: float, high: float, bins: int) -> DataFrame:
    inside = df.filter(F.col(x).between(low, high)).withColumn("bin", bin_of(F.col(x), low, high, bins))
    return inside.groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def in_domain_order(df: DataFrame, key: str, domain: list) -> DataFrame:
    """Rows whose key is in the domain, in its order."""
    place = F.array_position(F.array(*[F.lit(v) for v in domain]), F.col(key))
    return df.filter(place > 0).orderBy(place)
