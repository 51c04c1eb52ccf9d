from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from curvestat.llm import golay, simhash
from tests.llm.common import clashing, documents, frame


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i] ^ items[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 4000)
    w = v.copy()
    for _ in range(2):
        w ^= np.where(rng.random(4000) < 0.9, 1 << rng.integers(0, 23, 4000), 0)
    table = golay.patterns()
    assert all(set(a) & set(b) for a, b in zip(golay.keys(v, table), golay.keys(w, table), strict=True))
    assert {len(set(k)) for k in golay.keys(v, table)} == {1, 6}


def test_classes_match_brute_force(spark):
    rows = documents()
    got = {}
    for r in simhash.classes(frame(spark)).collect():
        got.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    prints = [fingerprint(r[1]) for r in rows]
    roots = brute_components(prints)
    for i, r in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        assert got[r[0]] == {(f"{prints[i]:016x}", min(members, default=None))}
    assert simhash.classes(frame(spark)).count() == len(rows)


@pytest.mark.parametrize(("crowd", "group"), [(3, 256), (60, 256), (60, 4), (200, 12)])
def test_links_of_crowded_fingerprints(spark, monkeypatch, crowd, group):
    """Chains and clusters around one value: components equal those of all pairs, whatever way crowded keys go."""
    monkeypatch.setattr(simhash, "GROUP", group)
    draw = random.Random(crowd)
    centre, values = draw.getrandbits(64), set()
    while len(values) < crowd:
        v = centre
        for _ in range(draw.randint(0, 5)):
            v ^= 1 << draw.randrange(64)
        values.add(v)
    values |= {draw.getrandbits(64) for _ in range(20)}
    items = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in items]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    from curvestat.llm.graph import components

    found = {r["node"]: r["root"] for r in components(simhash.links(nodes)).collect()}
    roots = brute_components(items)
    grouped = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
    assert grouped(roots) == grouped([found.get(v, v) for v in signed])
    went = simhash.routes(nodes)
    assert (went["anew"] > 0) == (went["neighbours"] > 0) == (group < crowd)
    assert crowd == 3 or went["row"] > 0


def test_keep_one(spark):
    kept = simhash.keep_one(clashing(frame(spark)))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == clashing(frame(spark)).columns
    assert len(ids) == len(set(ids)) and 3 in ids and 105 not in ids and ids.count(7) == 1 and set(range(40)) <= set(ids)


def test_empty_table(spark):
    assert simhash.classes(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_keep_one_of_a_repeated_doc_id_with_other_texts(spark):
    """Two components whose smallest doc_id is the same one both keep a row."""
    from tests.llm.common import prose

    one, two = prose(801, 80), prose(802, 80)
    rows = [(1, one, "en", "s", 0), (1, two, "en", "s", 0), (2, one, "en", "s", 0), (3, two, "en", "s", 0), (1, one, "en", "s", 0)]
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(frame(spark, rows)).collect()) == sorted([(1, one), (1, two)])


def test_keep_one_without_broadcasts(spark, monkeypatch):
    """The shuffled way of every join with a table of keys keeps the same rows."""
    from curvestat.llm import near_copies

    want = sorted(map(tuple, simhash.keep_one(frame(spark)).collect()), key=str)
    monkeypatch.setattr(simhash, "MOST_BROADCAST", 0)
    monkeypatch.setattr(near_copies, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, simhash.keep_one(frame(spark)).collect()), key=str) == want
