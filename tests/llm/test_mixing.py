from __future__ import annotations

import re
from collections import defaultdict

import pytest

from curvestat.llm import mixing as M
from tests.llm.common import clashing, documents, frame, prose


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def water(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, total = {}, set(sizes), 1.5 * sum(sizes.values())
    while open_:
        left = total - sum(target.values())
        rest = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / rest > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / rest for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("block", [2, 5, 64])
def test_targets_and_copies(spark, block):
    rows = documents() + [(1000 + i, prose(i, 10 + i % 50), "en", "big", 0) for i in range(400)]
    got = [tuple(r) for r in M.mix(clashing(frame(spark, rows)), block).collect()]
    assert len(got) == len(rows)
    sizes, source, most = defaultdict(int), {}, defaultdict(int)
    for doc_id, text, _, src, _ in rows:
        sizes[src] += words(text)
        source[doc_id] = src
        most[src] = max(most[src], words(text))
    goal, taken = water(sizes), defaultdict(int)
    for doc_id, size, source_size, target, n in got:
        src = source[doc_id]
        taken[src] += n
        assert source_size == sizes[src] and target == pytest.approx(goal[src]) and 0 <= n <= 2 * size and (size == 0 or n % size == 0)
    for src in sizes:
        assert abs(taken[src] - goal[src]) <= most[src] + 1e-6
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in M.mix(clashing(frame(spark, rows)).repartition(5), block).collect())


def test_rounding_is_unbiased(spark):
    """Over many documents of one size the chosen share is the target's, to within one document."""
    rows = [(i, "one two three", "en", "a" if i % 2 else "b", 0) for i in range(600)]
    got = M.mix(frame(spark, rows)).collect()
    by = defaultdict(int)
    for r in got:
        by[r["doc_id"] % 2] += r["taken"]
    assert abs(by[1] - 1800) <= 3 and abs(by[0] - 900) <= 3


def test_apply_mix(spark):
    df = clashing(frame(spark))
    out = M.apply_mix(df)
    assert out.columns == df.columns
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in M.mix(df).collect() if r["size"] and r["doc_id"] != 7}
    seen = defaultdict(int)
    for r in out.select("doc_id").collect():
        seen[r[0]] += 1
    assert all(seen[d] == n for d, n in copies.items())


def test_hundred_thousand_equal_rows(spark):
    """Equal rows take their share together: no block holds them, and copies are even to within one."""
    equal = spark.range(100_000).selectExpr("7L AS doc_id", "'three words here' AS text", "'a' AS source")
    other = spark.range(300).selectExpr("id + 100 AS doc_id", "'one two three four' AS text", "CASE WHEN id < 200 THEN 'b' END AS source")
    docs = equal.unionByName(other)
    got = M.mix(docs).groupBy("source_size", "target", "taken").count().collect()
    own = [r for r in got if r["source_size"] == 300_000]
    goal = water({"a": 300_000, "b": 800, None: 400})
    taken = sum(r["taken"] * r["count"] for r in own)
    assert sum(r["count"] for r in own) == 100_000 and len({r["taken"] for r in own}) <= 2 and abs(taken - goal["a"]) <= 3
    assert M.apply_mix(docs).filter("source = 'a'").count() * 3 == taken


def test_equal_rows_at_a_low_ratio(spark):
    """1,000 equal rows at a tenth are taken a hundred times, not each of them."""
    rows = [(1, "one two", "en", "a", 0)] * 1000 + [(2 + i, "w " * 500, "en", "b", 0) for i in range(60)]
    sizes = {"a": 2000, "b": 30000}
    want = water(sizes)["a"] / 2
    got = M.apply_mix(frame(spark, rows)).filter("source = 'a'").count()
    assert abs(got - want) <= 1 and M.mix(frame(spark, rows)).filter("doc_id = 1").count() == 1000


def test_empty_tables(spark):
    assert M.mix(frame(spark, [])).count() == 0 and M.apply_mix(frame(spark, [])).count() == 0
    silent = [(1, None, "en", "a", 0), (2, " ", "en", None, 0)]
    assert [(r["size"], r["target"], r["taken"]) for r in M.mix(frame(spark, silent)).collect()] == [(0, 0.0, 0)] * 2
