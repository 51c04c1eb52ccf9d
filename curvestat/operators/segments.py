"""Running numbers and neighbours in groups of any size; no task ever sorts a whole group.

A window over a hot key is one sort in one task. Here rows are sorted by keys and order over range partitions of
at most about ``SEGMENT`` rows. The part of a group inside one partition is a *segment*, in which plain windows count. At most one
segment in each partition continues a group of the partition before it, so what windows can't see is a table of at
most one row a partition for numbers (rows of the group in earlier partitions), and at most twice the distance for
neighbours (a segment's first and last rows). It is joined in.

The order must tell all rows of a group apart: rows that tie can't be split between partitions, and their numbers would
depend on the run. Null keys make a group, nulls in the order come first or as it says, an empty table gives no
rows, and names of the table's own columns may be any but those that begin with ``seg_``. Partitions are fixed by a reliable
checkpoint, as boundaries come from a sample that another run may draw anew.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvestat.operators.lineage import cut, few

SEGMENT = 1_000_000
#: Rows below which a partition isn't worth its task.
LEAST = 10_000
_ROWS = (1 << 33) - 1


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(and_, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def _ordered(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _parts(df: DataFrame, segment: int | None) -> int:
    """Partitions of ``segment`` rows; without it, of at most SEGMENT rows, and as many as a shuffle has while they hold LEAST."""
    rows = df.count()
    if segment is not None:
        return max(1, -(-rows // segment))
    return max(1, -(-rows // SEGMENT), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // LEAST)))


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "trial", segment: int | None = None) -> DataFrame:
    """df with each row's number in its group, from 1, and the columns seg_part, seg_at, seg_size that ``neighbour`` uses."""
    by = [*[F.col(k) for k in keys], *_ordered(order)]
    parts = _parts(df, segment)
    dealt = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = cut(dealt.withColumn("seg_part", F.spark_partition_id()).withColumn("seg_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS))))
    inside = Window.partitionBy("seg_part", *keys)
    at = placed.withColumn("seg_at", F.row_number().over(inside.orderBy("seg_row")).cast("long")).withColumn("seg_size", F.count("*").over(inside))
    # only a partition's last segment goes on in the next one, and only its first continues one
    ends = placed.groupBy("seg_part").agg(F.max("seg_row").alias("seg_end"))
    runs = placed.groupBy("seg_part", *keys).agg(F.min("seg_row").alias("seg_first"), F.max("seg_row").alias("seg_last"), F.count("*").alias("seg_n"))
    border = cut(runs.join(few(ends), "seg_part").filter("seg_first = 0 OR seg_last = seg_end").select("seg_part", *keys, "seg_n"))
    before = F.sum("seg_n").over(Window.partitionBy(*keys).orderBy("seg_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = border.withColumn("seg_before", before).filter("seg_before > 0")
    offsets = few(cut(offsets.select(F.col("seg_part").alias("seg_part_"), *[F.col(k).alias(f"seg_key{i}") for i, k in enumerate(keys)], "seg_before")))
    names = [("seg_part", "seg_part_"), *[(k, f"seg_key{i}") for i, k in enumerate(keys)]]
    joined = at.join(offsets, _same(at, offsets, names), "left")
    return joined.withColumn(name, F.col("seg_at") + F.coalesce("seg_before", F.lit(0))).drop("seg_row", "seg_before", *[b for _, b in names])


_OWN = ("seg_part", "seg_at", "seg_size")


def plain(df: DataFrame) -> DataFrame:
    """Without the columns that ``ranked`` keeps for ``neighbour``."""
    return df.drop(*_OWN)


def neighbour(rows: DataFrame, keys: list[str], value: str, by: int, name: str, rank: str = "trial") -> DataFrame:
    """``ranked`` rows with the value of the row ``by`` places earlier in the group (later where by is below 0); null where there is none."""
    if by == 0:
        return rows.withColumn(name, F.col(value))
    far = abs(by)
    inside = Window.partitionBy("seg_part", *keys).orderBy("seg_at")
    own = F.lag(value, far) if by > 0 else F.lead(value, far)
    marked = rows.withColumn("seg_own", own.over(inside))
    near = F.col("seg_at") <= far if by > 0 else F.col("seg_at") > F.col("seg_size") - far
    # a row that its segment has no partner for finds it at the other end of another segment
    source = F.col("seg_at") > F.col("seg_size") - far if by > 0 else F.col("seg_at") <= far
    held = rows.filter(source).select(*[F.col(k).alias(f"seg_key{i}") for i, k in enumerate(keys)], (F.col(rank) + by).alias("seg_rank"), F.col(value).alias("seg_value"), F.col("seg_part").alias("seg_from"))
    edges = _edges(rows, keys)
    held = held.join(edges, _same(held, edges, [("seg_from", "seg_part_"), *[(f"seg_key{i}", f"seg_e{i}") for i in range(len(keys))]]), "left_semi")
    held = few(cut(held))
    names = [*[(k, f"seg_key{i}") for i, k in enumerate(keys)], (rank, "seg_rank")]
    joined = marked.join(held, _same(marked, held, names) & near, "left")
    return joined.withColumn(name, F.when(near, F.col("seg_value")).otherwise(F.col("seg_own"))).drop("seg_own", "seg_value", "seg_from", *[b for _, b in names])


def _edges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of groups that lie in several partitions."""
    segments = rows.filter("seg_at = 1").select("seg_part", *keys)
    split = segments.groupBy(*keys).agg(F.min("seg_part").alias("seg_low"), F.max("seg_part").alias("seg_high")).filter("seg_low < seg_high") if keys else segments.agg(F.min("seg_part").alias("seg_low"), F.max("seg_part").alias("seg_high")).filter("seg_low < seg_high")
    split = split.select(*[F.col(k).alias(f"seg_e{i}") for i, k in enumerate(keys)], F.explode(F.sequence("seg_low", "seg_high")).alias("seg_part_"))
    return few(cut(split))


def rank_in_group(df: DataFrame, keys: list[str], order: list, name: str = "trial", segment: int | None = None) -> DataFrame:
    return plain(ranked(df, keys, order, name, segment))


def top_in_group(df: DataFrame, keys: list[str], order: list, k: int, segment: int | None = None) -> DataFrame:
    return rank_in_group(df, keys, order, "place", segment).filter(F.col("place") <= k)


def paired(df: DataFrame, keys: list[str], order: list, value: str, lag: int, segment: int | None = None) -> DataFrame:
    """Rows with the value ``lag`` rows later in the group as ``later``; rows without one go."""
    return plain(neighbour(ranked(df, keys, order, "seg_no", segment), keys, value, -lag, "later", "seg_no")).drop("seg_no").filter(F.col("later").isNotNull())


def differences(df: DataFrame, keys: list[str], order: list, value: str, name: str = "rise", segment: int | None = None) -> DataFrame:
    """Rows with their value less that of the row before; null in a group's first row."""
    before = neighbour(ranked(df, keys, order, "seg_no", segment), keys, value, 1, "seg_before", "seg_no")
    return plain(before.withColumn(name, F.col(value) - F.col("seg_before"))).drop("seg_no", "seg_before")


def contiguity(df: DataFrame, cell: list[str], label: str, index: str, segment: int | None = None) -> DataFrame:
    """Rows of each cell, whether its labels are 1..n and whether its indices rise by one along them; labels differ within a cell."""
    before = neighbour(ranked(df, cell, [label], "seg_no", segment), cell, index, 1, "seg_before", "seg_no")
    rise = F.col(index) - F.col("seg_before")
    return before.groupBy(*cell).agg(
        F.count("*").alias("rows"), F.bool_and(F.col(label) == F.col("seg_no")).alias("labels_complete"),
        F.bool_and(F.coalesce(rise == 1, F.lit(True))).alias("contiguous"), F.min(index).alias("first_index"), F.max(index).alias("last_index"),
    )
