from __future__ import annotations

import hashlib
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from curvestat.llm import merkle_manifest as M
from tests.llm.common import clashing, documents, frame, prose


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row) -> str:
    doc_id, text, lang, source, n_chars = row
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each node the siblings left and right of it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run, o = nodes[p // 8 * 8 : p // 8 * 8 + 8], p % 8
            paths[i].append(("".join(run[:o]), "".join(run[o + 1 :])))
        nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
    return nodes[0], paths


def brute(rows) -> Counter:
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    found = []
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        found.append((own, *climb([leaf(r) for r in own])))
    root, upper = climb([f[1] for f in found])
    out: Counter = Counter()
    for (own, subroot, paths), above in zip(found, upper, strict=True):
        for r, path in zip(own, paths, strict=True):
            lowered = None if r[1] is None else "".join(c.lower() if c.isascii() else c for c in r[1])
            node = leaf((r[0], lowered, *r[2:])) if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            for left, right in path + above:
                node = h(left, node, right)
            out[(r[0], leaf(r), subroot, root, h(*[x for p in path + above for x in p]), node, node == root)] += 1
    return out


def got(df) -> Counter:
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in df.collect())


def test_against_brute_force(spark):
    rows = documents() + [(300 + i, prose(i, 12), None if i % 3 else "zz", "src9", i) for i in range(90)] + [(700, "lone", "pt", None, 4)]
    want = brute(rows)
    assert got(M.manifest(frame(spark, rows))) == want
    verified = [k[-1] for k in want]
    assert any(verified) and not all(verified)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_shapes_of_trees_over_several_rounds(spark, monkeypatch, n):
    """Buckets of 64 leaves, so that trees take up to two rounds of buckets above the first."""
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "BUCKET", 64)
    rows = [(i, f"Text {i}", "en" if i % 7 else "de", "s", i) for i in range(n)]
    assert got(M.manifest(frame(spark, rows))) == brute(rows)


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "BUCKET", 8)
    rows = [(i, f"T{i}", f"l{i % 70}", "s", i) for i in range(150)]
    assert got(M.manifest(frame(spark, rows))) == brute(rows)


def test_one_row_that_is_most_of_the_table(spark):
    rows = [(5, "The same row", "en", "s", 1)] * 3000 + [(i, f"Row {i}", "en", "s", i) for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this table is small
    try:
        placed = M.placed(M.leaves(frame(spark, rows).repartition(8)).withColumnRenamed("leaf", "node"), ["doc_id", "node", "number"])
        assert sorted(r["pos"] for r in placed.select("pos").collect()) == list(range(len(rows)))
        assert placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got(M.manifest(frame(spark, rows))) == brute(rows)


def test_any_change_shows(spark):
    rows = [(i, f"Text {i}", "en" if i % 2 else "fr", "s", i) for i in range(30)]
    root = lambda x: next(iter(got(M.manifest(frame(spark, x)))))[3]
    base = root(rows)
    assert root(rows[::-1]) == base
    for other in ([*rows[:-1], (29, "Text 29 ", "en", "s", 29)], rows[:-1], [*rows, rows[0]], [(i, rows[(i + 1) % 30][1], *r[2:]) for i, r in enumerate(rows)]):
        assert root(other) != base


def test_awkward_tables(spark):
    assert got(M.manifest(frame(spark, []))) == Counter()
    rows = [(None, None, None, None, None)] * 2 + [(1, "", "", "", 0)]
    df = clashing(frame(spark, rows)).selectExpr("*", "1 AS tree", "2 AS node", "3 AS number", "4 AS pos", "5 AS n", "6 AS leaf")
    assert got(M.manifest(df)) == brute(rows)
