"""Segmented ranks and neighbours against plain windows, with groups cut into many segments."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from curvestat.operators import segments, windows


@pytest.fixture(scope="module")
def rows(spark):
    """Half of 600 rows in one group, the others in groups of one to a few, among them a null key."""
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 97)
    df = spark.range(600).select("id", key.cast("int").alias("k"), (F.col("id") * 389 % 601).alias("t"), F.when(F.col("id") % 11 > 0, F.col("id") * 0.5).alias("v"))
    return df


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    plain = lambda df: sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert plain(a) == plain(b)


@pytest.mark.parametrize("segment", [7, 40, 1000])
def test_ranks_are_those_of_the_window(spark, rows, segment):
    for order in (["t"], [F.col("v").desc(), F.col("t")]):
        want = windows.trial_rank(rows, ["k"], order).withColumn("trial", F.col("trial").cast("long"))
        same(segments.rank_in_group(rows, ["k"], order, segment=segment), want)
    want = windows.top_per_group(rows, ["k"], ["t"], 3).withColumn("place", F.col("place").cast("long"))
    same(segments.top_in_group(rows, ["k"], ["t"], 3, segment), want)


@pytest.mark.parametrize("by", [1, -1, 3, -10, 45])
def test_neighbours_cross_the_borders_of_segments(spark, rows, by):
    w = Window.partitionBy("k").orderBy("t")
    want = rows.withColumn("trial", F.row_number().over(w).cast("long")).withColumn("other", F.lag("v", by).over(w))
    for segment in (7, 100):
        got = segments.plain(segments.neighbour(segments.ranked(rows, ["k"], ["t"], segment=segment), ["k"], "v", by, "other"))
        same(got, want)


def test_pairs_and_differences(spark, rows):
    same(segments.paired(rows, ["k"], ["t"], "v", 2, segment=9), windows.lag_pairs(rows, ["k"], "t", "v", 2))
    w = Window.partitionBy("k").orderBy("t")
    same(segments.differences(rows, ["k"], ["t"], "id", segment=9), rows.withColumn("rise", F.col("id") - F.lag("id").over(w)))


def test_one_group_without_keys_and_empty_tables(spark, rows):
    got = segments.differences(rows.select("id"), [], ["id"], "id", segment=50)
    assert sorted(str(r["rise"]) for r in got.collect()) == ["1"] * 599 + ["None"]
    assert segments.rank_in_group(rows.limit(0), ["k"], ["t"]).count() == 0
    assert segments.paired(rows.limit(0), ["k"], ["t"], "v", 1).count() == 0


def test_contiguity_finds_a_gap_at_any_place(spark):
    whole = spark.range(1, 301).select(F.lit("a").alias("cell"), F.col("id").alias("label"), (F.col("id") + 900).alias("i"))
    for gap in (2, 31, 150, 300):
        broken = whole.withColumn("i", F.col("i") + F.when(F.col("label") >= gap, 1).otherwise(0))
        df = whole.unionByName(broken.withColumn("cell", F.lit("b"))).unionByName(whole.filter(F.col("label") != gap).withColumn("cell", F.lit("c")))
        same(segments.contiguity(df, ["cell"], "label", "i", segment=30), windows.contiguity(df, ["cell"], "label", "i"))


def test_all_of_three_million_rows_in_one_cell(spark):
    n = 3_000_000
    df = spark.range(n).select(F.lit(1).alias("cell"), (F.col("id") * 7_654_321 % n).alias("label"))
    got = segments.ranked(df, ["cell"], ["label"], segment=250_000)
    wrong, tasks, most = got.agg(F.count_if(F.col("trial") != F.col("label") + 1), F.count_distinct("seg_part"), F.max("seg_size")).first()
    assert wrong == 0 and tasks == 12 and most < 500_000
    out = segments.contiguity(df.withColumn("label", F.col("label") + 1).withColumn("i", F.col("label")), ["cell"], "label", "i", segment=250_000).first()
    assert (out["rows"], out["labels_complete"], out["contiguous"]) == (n, True, True)
