"""Influence of single groups, registration sensitivity, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvestat.functions import arrays
from curvestat.functions.arrays import node_weight
from curvestat.operators.components import components_from_sums
from curvestat.operators.windows import share_of_total


def leave_one_out(cells: DataFrame, keys: list[str], group: str = "athlete") -> DataFrame:
    """Components without each group, from cell statistics of one size a key.

    Each group's part is taken from the totals of its key: as many rows as cells, whatever
    the number of groups. Means are centred on the key's own first, so that nothing cancels.
    """
    means = cells.groupBy(*keys).agg(F.avg("mean").alias("centre"), F.count("*").alias("groups"), F.min("n").alias("m"), F.sum("ss").alias("ss_all"))
    centred = cells.join(means, keys) if keys else cells.crossJoin(F.broadcast(means))
    d = F.col("mean") - F.col("centre")
    squares = centred.groupBy(*keys).agg(F.sum(d * d).alias("squares"))
    every = centred.join(squares, keys) if keys else centred.crossJoin(F.broadcast(squares))
    p = F.col("groups") - 1
    # the deviations sum to zero, so those of the others sum to -d
    ssb = F.col("m") * F.greatest(F.col("squares") - d * d - d * d / p, F.lit(0.0))
    left = every.select(F.col(group).alias("excluded"), *keys, p.alias("p"), "m", ssb.alias("ssb"), (F.col("ss_all") - F.col("ss")).alias("ssw"))
    return components_from_sums(left)


def contributions(cells: DataFrame, keys: list[str], nodes: int, group: str = "athlete") -> DataFrame:
    """Integrated within-group sum of squares and squared deviation of the group mean, as shares of their totals."""
    grand = F.avg("mean").over(Window.partitionBy(*keys, "node"))
    w = node_weight(F.col("node"), nodes)
    d = F.col("mean") - F.col("grand")
    per = cells.withColumn("grand", grand).groupBy(*keys, group).agg(F.sum(w * F.col("ss")).alias("within_ss"), F.sum(w * d * d).alias("deviation"))
    return share_of_total(share_of_total(per, keys, "within_ss", "within_share"), keys, "deviation", "deviation_share")


def register(curves: DataFrame, keys: list[str], nodes: int, landmark: str = "landmark", window: int = 11, low: float = 10, high: float = 90) -> DataFrame:
    """Peak, reference and warped y of each curve: peaks are found on smoothed landmark curves, the warp is applied to y.

    The reference is the rounded (half to even) median peak of each combination of keys.
    """
    lo, hi = arrays.search_range(nodes, low, high)
    peaked = curves.withColumn("peak", arrays.peak(arrays.moving_average_nearest(F.col(landmark), window), lo, hi))
    medians = peaked.groupBy(*keys).agg(F.rint(F.median("peak")).alias("reference")) if keys else peaked.agg(F.rint(F.median("peak")).alias("reference"))
    joined = peaked.join(medians, keys) if keys else peaked.crossJoin(F.broadcast(medians))
    return joined.withColumn("warped", arrays.warp(F.col("y"), F.col("peak").cast("double"), F.col("reference"), nodes))


def duplicate_groups(rows: DataFrame, key: str, prefix: int = 3) -> DataFrame:
    """Rows whose key (a digest) occurs twice or more, with a group number by sorted key and the group's size.

    Sizes come from a partially aggregated count joined back, not from a window,
    so a key held by many rows is counted where they lie. Numbers come from the
    repeated keys alone, ranked inside each prefix of the digest; what lies before a prefix
    is summed over the prefixes, at most 16 to the power of its length.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("group_size")).filter(F.col("group_size") > 1).withColumn("prefix", F.substring(key, 1, prefix))
    counts = sizes.groupBy(F.col("prefix").alias("p_prefix")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("p_prefix", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("prefix").orderBy(key))
    numbered = sizes.withColumn("inside", inside).join(F.broadcast(offsets), F.col("prefix") == F.col("p_prefix"))
    return rows.join(numbered.select(key, "group_size", (F.col("before") + F.col("inside")).cast("int").alias("duplicate_group")), key)


def duplicate_removals(members: DataFrame, participant: str, index: str, quarantine_above: int) -> DataFrame:
    """One member of each group to drop: the only one above the quarantine code, else the last by (participant, index)."""
    above = F.count_if(F.col(participant) > quarantine_above)
    # a lone member above the code is also the last one
    chosen = members.groupBy("duplicate_group").agg(F.max(F.struct(participant, index)).alias("o"), F.max("group_size").alias("group_size"), (above == 1).alias("quarantined"))
    return chosen.select("duplicate_group", "group_size", F.col(f"o.{participant}").alias(participant), F.col(f"o.{index}").alias(index), "quarantined")
