"""Exact quantiles against DuckDB's quantile_cont, which rounds once less where it interpolates."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvestat.operators import quantiles as Q

PS = [0.0, 0.025, 0.25, 0.5, 0.95, 0.999, 1.0]


def duck(frame: pd.DataFrame, keys: str) -> dict:
    import duckdb

    con = duckdb.connect()
    con.register("t", frame)
    columns = ", ".join(f"quantile_cont(v, {p})" for p in PS)
    return {r[0]: list(r[1:]) for r in con.sql(f"SELECT {keys}, {columns} FROM t WHERE v IS NOT NULL GROUP BY 1").fetchall()}


def same(a: dict, b: dict) -> bool:
    return a.keys() == b.keys() and all(x == pytest.approx(y, rel=4e-16, abs=0) for k in a for x, y in zip(a[k], b[k], strict=True))


def values(draw, n: int) -> np.ndarray:
    """Over 600 orders of magnitude, with ties."""
    x = np.exp(draw.uniform(-700, 700, n)) * draw.choice([-1, 1], n)
    x[: n // 5] = np.round(draw.normal(size=n // 5), 1)
    return draw.permutation(x)


@pytest.mark.parametrize(("gathered", "accuracy", "bins"), [(100_000, 10_000, 128), (50, 100, 8), (10, 50, 4)])
def test_groups_of_all_sizes(spark, monkeypatch, gathered, accuracy, bins):
    for name, x in (("ACCURACY", accuracy), ("BINS", bins)):
        monkeypatch.setattr(Q, name, x)
    draw = np.random.default_rng(1)
    sizes = {1: 1, 2: 2, 3: 7, 4: 400, 5: 9000}
    frame = pd.DataFrame({"k": np.repeat(list(sizes), list(sizes.values())), "v": np.concatenate([values(draw, n) for n in sizes.values()])})
    out = {r["k"]: r["q"] for r in Q.quantiles(spark.createDataFrame(frame), ["k"], "v", PS, gathered).collect()}
    assert same(out, duck(frame, "k"))


def test_brackets_that_miss_are_made_wider(spark, monkeypatch):
    """With a margin of almost nothing the sketch's brackets miss some ranks at first."""
    monkeypatch.setattr(Q, "ACCURACY", 20)
    monkeypatch.setattr(Q, "MARGIN", 0.01)
    draw = np.random.default_rng(2)
    frame = pd.DataFrame({"k": 1, "v": values(draw, 5000)})
    out = {r["k"]: r["q"] for r in Q.quantiles(spark.createDataFrame(frame), ["k"], "v", PS, 100).collect()}
    assert same(out, duck(frame, "k"))


def test_nulls_null_keys_and_no_keys(spark):
    rows = [(None, 1.0), (None, 3.0), (1, None), (2, None), (2, 5.0), (3, 2.0), (3, 2.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    assert {r["k"]: r["q"] for r in Q.quantiles(df, ["k"], "v", [0.5]).collect()} == {None: [2.0], 2: [5.0], 3: [2.0]}
    assert {r["k"]: r["q"] for r in Q.quantiles(df, ["k"], "v", [0.5], 1).collect()} == {None: [2.0], 2: [5.0], 3: [2.0]}
    assert [r["q"] for r in Q.quantiles(df, [], "v", [0.5, 1.0]).collect()] == [[2.0, 5.0]]
    assert Q.quantiles(df.limit(0), ["k"], "v", [0.5]).collect() == []
    with pytest.raises(ValueError):
        Q.quantiles(df, ["k"], "v", [1.5])


def test_one_group_of_ten_million_different_values(spark):
    """Odd multipliers permute the numbers below a power of two, so order statistics are known."""
    n = 10_000_000
    df = spark.range(0, n, 1, 16).select(F.lit("a").alias("k"), ((F.col("id") * 1_234_577 % n) / 8).alias("v"))
    (row,) = Q.quantiles(df, ["k"], "v", PS).collect()
    for p, q in zip(PS, row["q"], strict=True):
        at = p * (n - 1)
        low = np.floor(at)
        assert q == (low / 8 if at == low else low / 8 * (1 - (at - low)) + np.ceil(at) / 8 * (at - low))
