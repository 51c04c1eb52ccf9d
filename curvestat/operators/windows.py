"""Window operators over trials and nodes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvestat.functions.reliability import safe_ratio
from curvestat.operators.lineage import cut, few
from curvestat.operators.quantiles import quantiles


def trial_rank(df: DataFrame, cell: list[str], order: list, name: str = "trial") -> DataFrame:
    """Running number of each row in its cell, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; order must end in a tie-breaker."""
    return trial_rank(df, keys, order, "place").filter(F.col("place") <= k)


def robust_z(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds group median, unscaled MAD and (x - median) / (1.4826 MAD), null where MAD is 0.

    Medians are exact and found without bringing a group's values together; they are joined back as small tables.
    """
    at = [F.col(k).alias(f"m_{k}") for k in keys]
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys])
    named = [f"m_{k}" for k in keys]
    medians = quantiles(df, keys, value, [0.5]).select(*at, F.get("q", F.lit(0)).alias("median"))
    df = df.join(few(cut(medians)), same).drop(*named).withColumn("deviation", F.abs(F.col(value) - F.col("median")))
    spreads = quantiles(df, keys, "deviation", [0.5]).select(*at, F.get("q", F.lit(0)).alias("mad"))
    df = df.join(few(cut(spreads)), same).drop(*named)
    return df.withColumn("robust_z", F.when(F.col("mad") > 0, (F.col(value) - F.col("median")) / (1.4826 * F.col("mad")))).drop("deviation")


def lag_pairs(df: DataFrame, keys: list[str], order: str, value: str, lag: int) -> DataFrame:
    """Adds the value ``lag`` rows later in the group as ``later``; rows without one go."""
    return df.withColumn("later", F.lead(value, lag).over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("later").isNotNull())


def centred(df: DataFrame, keys: list[str], value: str, name: str = "r") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def display_mean(df: DataFrame, keys: list[str], order: str, value: str, half: int = 5) -> Column:
    """Rolling mean over half rows on either side that shrinks at the edges."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half))


def share_of_total(df: DataFrame, keys: list[str], value: str, name: str = "share") -> DataFrame:
    return df.withColumn(name, safe_ratio(F.col(value), F.sum(value).over(Window.partitionBy(*keys))))


def contiguity(df: DataFrame, cell: list[str], label: str, index: str) -> DataFrame:
    """Rows of each cell, whether labels are 1..n, and whether indices rise by one."""
    w = Window.partitionBy(*cell).orderBy(label)
    marked = df.withColumn("at", F.row_number().over(w)).withColumn("rise", F.col(index) - F.lag(index).over(w))
    return marked.groupBy(*cell).agg(
        F.count("*").alias("rows"), F.bool_and(F.col(label) == F.col("at")).alias("labels_complete"),
        F.bool_and(F.coalesce(F.col("rise") == 1, F.lit(True))).alias("contiguous"), F.min(index).alias("first_index"), F.max(index).alias("last_index"),
    )
