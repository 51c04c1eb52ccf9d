from __future__ import annotations

import numpy as np
import pytest

from curvestat.llm import embedding_dedup as E

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], None if v is None else [None if x is None else float(x) for x in v], i % 3) for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, ids=None) -> list[tuple]:
    ids = list(range(len(vectors))) if ids is None else ids
    unit = []
    for v in vectors:
        x = None if v is None or not len(v) or any(c is None for c in v) else np.asarray(np.asarray(v, dtype=np.float32), dtype=np.float64)
        unit.append(None if x is None or not np.isfinite(x).all() or not x.any() else x / np.linalg.norm(x))
    near = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.95] for i, a in enumerate(unit)]
    out = []
    for i in range(len(vectors)):
        seen, left = {i}, [i]
        while left:
            for j in near[left.pop()]:
                if j not in seen:
                    seen.add(j)
                    left.append(j)
        low = min((ids[j] for j in seen if ids[j] is not None), default=None)
        out.append((ids[i], len(near[i]), low, low is not None and ids[i] == low))
    return out


def got(df) -> list[tuple]:
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planted(d: int, groups: int = 12, seed: int = 0) -> list[np.ndarray]:
    """Single vectors, pairs at cosines about 0.95, chains, copies, scaled copies and a group in one direction."""
    draw = np.random.default_rng([seed, d])

    def at(v, cosine):
        w = draw.standard_normal(d)
        w -= (w @ v) * v / (v @ v)
        return cosine * v + np.sqrt(1 - cosine**2) * np.linalg.norm(v) * w / np.linalg.norm(w)

    out = list(draw.standard_normal((40, d)))
    for i in range(groups):
        v = draw.standard_normal(d)
        out += [v, at(v, 0.951 + 0.004 * i), at(v, 0.949 - 0.002 * i), at(v, 0.999), v.copy(), 3 * v]
        for _ in range(3):
            v = at(v, 0.955)
            out.append(v)
    centre = draw.standard_normal(d)
    return out + [at(centre, 0.978) for _ in range(60)]


def coded(packed, factor):
    return {"signs": E.signs(packed, 64), "factor": factor, "slack": E.slack(factor, 64)}


@pytest.mark.parametrize(("d", "tile", "small"), [(64, 512, 32), (64, 16, 4), (10, 512, 2), (100, 32, 100)])
def test_against_brute_force(spark, monkeypatch, d, tile, small):
    monkeypatch.setattr(E, "TILE", tile)
    monkeypatch.setattr(E, "SMALL", small)
    monkeypatch.setattr(E, "TOGETHER", 64)
    vectors = planted(d)
    assert got(E.classes(table(spark, vectors))) == sorted(brute(vectors), key=repr)


def test_vectors_that_link_with_nothing(spark):
    vectors = [None, [], [0.0, -0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 1.0], [1.0, 1.0], [2.0, 2.0], [1.0, 1.0, 0.0], [-1.0, -1.0], [1e-30, 1e-30]]
    assert got(E.classes(table(spark, vectors))) == sorted(brute(vectors), key=repr)


def test_ids_repeat_or_are_null(spark):
    v, w = [1.0, 0.0, 0.5], [-1.0, 2.0, 0.0]
    vectors, ids = [v, v, w, w, v, [0.0, 0.0, 1.0]], [5, 5, None, None, None, None]
    assert got(E.classes(table(spark, vectors, ids))) == sorted(brute(vectors, ids), key=repr)


def test_empty_table_and_clashing_columns(spark):
    assert got(E.classes(table(spark, []))) == []
    df = table(spark, [[1.0, 2.0], [1.0, 2.0]]).selectExpr("*", "1 AS x", "2 AS node", "3 AS h1", "4 AS weight", "5 AS d", "6 AS key", "7 AS sound")
    assert got(E.classes(df)) == [(0, 1, 0, True), (1, 1, 0, False)]


def test_large_group_of_copies_is_one_node(spark):
    draw = np.random.default_rng(4)
    v = draw.standard_normal(16)
    vectors = [v] * 5000 + list(draw.standard_normal((20, 16)))
    out = got(E.classes(table(spark, vectors)))
    assert [r for r in out if r[0] < 5000] == sorted(((i, 4999, 0, i == 0) for i in range(5000)), key=repr)


def test_estimates_are_unbiased_and_within_their_bound():
    draw = np.random.default_rng(9)
    unit = E.units(draw.standard_normal(64 * 400), 64)
    packed, factor = E.code(unit)
    turned = unit @ E.rotation(64, 0)
    estimate = turned @ E.signs(packed, 64).T / 8 / factor
    off = (estimate - unit @ unit.T)[~np.eye(400, dtype=bool)]
    bound = E.slack(factor, 64)
    assert abs(off.mean()) < 1e-3 and 0.02 < off.std() < 0.2 and np.abs(off).max() < bound.max()
    assert np.allclose(np.diag(estimate), 1)
    may = E.possible(turned, coded(packed, factor))
    assert may.diagonal().all() and may.mean() < 0.01


def test_bands_follow_the_number_of_vectors():
    bits = [E.bands(n)[0] for n in (0, 10, 10**4, 10**6, 10**9, 10**15)]
    assert bits == sorted(bits) and bits[0] == E.LEAST_BITS and bits[-1] == E.MOST_BITS
    for n in (10, 10**5, 10**9):
        b, many = E.bands(n)
        assert (1 - (1 - np.arccos(E.LIKE) / np.pi) ** b) ** many <= E.MISSED


def test_recall_at_the_threshold():
    """Pairs at 0.9501 share a band as often as stated, whatever their direction."""
    draw = np.random.default_rng(1)
    a = E.units(draw.standard_normal(64 * 3000), 64)
    w = draw.standard_normal((3000, 64))
    w -= (w * a).sum(axis=1, keepdims=True) * a
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    bits, many = E.bands(50_000)
    assert (E.band_keys(a, bits, many) == E.band_keys(b, bits, many)).any(axis=1).mean() >= 0.999
    packed, factor = E.code(a)
    assert np.diagonal(E.possible(b[:500] @ E.rotation(64, 0), coded(packed[:500], factor[:500]))).all()
