from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from curvestat.llm import sharding as S
from tests.llm.common import clashing, documents, frame, prose


def check(rows, got, shards):
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("shards", [40, 5])
def test_law_and_facts(spark, shards):
    rows = documents()
    got = S.assign(clashing(frame(spark)), shards).collect()
    check(rows, got, shards)
    size = lambda t: len((t or "").encode()) + 16
    want = Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_groups_stay_together_and_a_hot_group_is_split(spark):
    draw = [(i, prose(i // 4, 20) if i < 200 else prose(i, 12), "en", "s", 0) for i in range(800)]
    hot = [(5000 + i, "the same text everywhere", "en", "s", 0) for i in range(400)]
    rows = draw + hot
    shards = 10
    got = S.assign(frame(spark, rows), shards).collect()
    check(rows, got, shards)
    at = {r["doc_id"]: r["shard"] for r in got}
    groups = defaultdict(set)
    for r in draw[:200]:
        groups[r[1]].add(at[r[0]])
    assert sum(len(g) > 1 for g in groups.values()) <= 5
    assert len({at[r[0]] for r in hot}) <= 5  # at least 4 are needed
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in S.assign(frame(spark, rows).repartition(7), shards).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_everything_linked(spark):
    rows = [(i, f"text {i % 60}", "en", "s", 0) for i in range(600)]
    got = S.assign(frame(spark, rows), 8).collect()
    check(rows, got, 8)
    groups = defaultdict(set)
    for r in got:
        groups[r["doc_id"] % 60].add(r["shard"])
    assert sum(len(g) == 1 for g in groups.values()) >= 40


def test_add_shards(spark):
    df = clashing(frame(spark))
    out = S.add_shards(df, 6)
    assert sorted(out.columns) == sorted(df.columns) and out.count() == df.count()
    check(documents(), out.select("shard", "slot").collect(), 6)


def test_propagation_cuts_fewer_edges_than_hashes(spark):
    """Groups of 2 to 9 copies: against placement by hash, few links are cut, and most groups lie in one shard."""
    rows = [(i, f"text {(i * i) % 701}", "en", "s", 0) for i in range(2000)]
    placed = S.assign(frame(spark, rows), 20)
    check(rows, placed.collect(), 20)
    by_hash = frame(spark, rows).selectExpr("crc32(cast(text as binary)) AS text_crc32", "length(text) AS size", "pmod(xxhash64(doc_id), 20) AS shard")
    before, after = S.cut_edges(by_hash), S.cut_edges(placed)
    assert before > 1000 and after < 0.1 * before


def test_hundred_thousand_equal_rows(spark, monkeypatch):
    """Equal rows are one row with a weight, and equal texts of many documents have bins of their own."""
    monkeypatch.setattr(S, "PER_BIN", 1000)
    equal = spark.range(100_000).selectExpr("7L AS doc_id", "'the same row' AS text")
    alike = spark.range(20_000).selectExpr("id + 100 AS doc_id", "'the same text' AS text")
    docs = equal.unionByName(alike)
    assert S.described(docs, ["doc_id", "text"], 40).count() == 20_001
    got = S.assign(docs, 40)
    per = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(per) == 40 and all(r["n"] == r["slots"] == r["last"] + 1 == 3000 for r in per)
    out = S.add_shards(docs, 40)
    assert out.count() == 120_000 and out.select("shard", "slot").distinct().count() == 120_000


def test_empty_table(spark):
    assert S.assign(frame(spark, [])).count() == 0 and S.add_shards(frame(spark, [])).count() == 0
