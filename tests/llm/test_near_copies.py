from __future__ import annotations

import numpy as np
import pytest

from curvestat.llm import near_copies as N
from curvestat.llm import simhash
from tests.llm.common import frame, prose


def similar(a, b):
    x, y = (set(zip(*[t.lower().split()[i:] for i in range(5)], strict=False)) for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


@pytest.mark.parametrize("crowd", [1024, 2])
def test_keep_one_drops_near_copies_beyond_two_bits(spark, monkeypatch, crowd):
    """Texts with some words replaced: of rows at 0.8 or more the first stays, as a greedy pass over all pairs finds."""
    monkeypatch.setattr(N, "ROWS_TOGETHER", crowd)
    rows = []
    for i in range(20):
        w = prose(6000 + i, 150).split()
        for j in range(5):
            v = list(w)
            for k in range(j):
                v[(37 * k + 11 * j + i) % 150] = f"new{i}x{j}x{k}"
            rows.append((5 * i + j, " ".join(v), "en", "s", 0))
    prints = [simhash.fingerprint(r[1].encode()) for r in rows]
    assert sum(similar(rows[5 * i][1], rows[5 * i + 2][1]) and (prints[5 * i] ^ prints[5 * i + 2]).bit_count() > 2 for i in range(20)) > 5
    kept = [r for r in simhash.keep_one(frame(spark, rows)).collect()]
    assert {5 * i for i in range(20)} <= {r["doc_id"] for r in kept}
    assert not any(similar(a["text"], b["text"]) for a in kept for b in kept if a["doc_id"] < b["doc_id"])
    assert all(any(similar(r[1], x[1]) or (simhash.fingerprint(r[1].encode()) ^ simhash.fingerprint(x[1].encode())).bit_count() <= 2 for x in rows[: r[0]]) for r in rows if r[0] not in {k["doc_id"] for k in kept})


def test_bands_of_long_texts_do_not_depend_on_blocks(monkeypatch):
    s = N.shingles(prose(1, 3000).encode())
    want = N.signature(s)[0].tolist()
    monkeypatch.setattr(N, "BLOCK", 100)
    assert N.signature(s)[0].tolist() == want and len(N.signature(N.shingles(b""))[0]) == 0


def test_comparison_in_one_task(monkeypatch):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 32, 200, dtype=np.uint32)
    sets = [np.unique(np.r_[draw.permutation(base)[: draw.integers(150, 200)], draw.integers(0, 1 << 32, draw.integers(0, 30), dtype=np.uint32)]) for _ in range(60)] + [np.empty(0, np.uint32)]
    like = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    want = [any(len(x) and like(x, y) for y in sets[:i]) for i, x in enumerate(sets)]
    for columns in (1 << 12, 7):
        monkeypatch.setattr(N, "COLUMNS", columns)
        assert N.later_alike(sets).tolist() == want and 5 < sum(want) < 58
