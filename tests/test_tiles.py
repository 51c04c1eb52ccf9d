"""Tiled Gram products and the permutation test over blocks of nodes and orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvestat.functions.arrays import weights
from curvestat.operators import dependence

NODES = 5


def table(spark, curves):
    """curves: {group: array of trials x nodes}."""
    rows = [(g, t + 1, n, float(v)) for g, x in curves.items() for t, c in enumerate(x) for n, v in enumerate(c)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["athlete", "trial", "node", "r"])).withColumn("node", F.col("node").cast("int"))


@pytest.fixture(scope="module")
def curves():
    rng = np.random.default_rng(5)
    return {1: rng.normal(size=(23, NODES)), 2: rng.normal(size=(1, NODES)), 3: rng.normal(size=(8, NODES))}


@pytest.mark.parametrize("tile", [1, 4, 100])
def test_tiles_give_every_product_once(spark, curves, tile):
    got = dependence.gram(table(spark, curves), [], NODES, tile=tile).collect()
    assert len(got) == len({(r["athlete"], r["i"], r["j"]) for r in got}) == 23 * 23 + 1 + 64
    w = np.asarray(weights(NODES))
    for r in got:
        x = curves[r["athlete"]]
        assert r["g"] == pytest.approx(float((x[r["i"] - 1] * w * x[r["j"] - 1]).sum()), abs=1e-12)


@pytest.mark.parametrize("same", [False, True])
def test_blocks_of_two_tiles_hold_both_orders_of_each_pair_once(monkeypatch, same):
    monkeypatch.setattr(dependence, "STRIP", 2)
    monkeypatch.setattr(dependence, "RUN", 3)
    rng = np.random.default_rng(8)
    i, left = np.arange(7), rng.normal(size=(7, NODES))
    j, right = (i, left) if same else (np.arange(20, 31), rng.normal(size=(11, NODES)))
    got = [row for block in dependence._products(i, left, j, right, same) for row in zip(*block, strict=True)]
    want = {pair: float(left[a] @ right[b]) for a, x in enumerate(i) for b, y in enumerate(j) for pair in ((x, y), (y, x))}
    assert len(got) == len(want)
    assert {(x, y): g for x, y, g in got} == pytest.approx(want, abs=1e-12)


def test_tiles_of_one_group_are_dealt_to_several_tasks(spark):
    """Also where all rows of a group lie in one partition, as they do behind a window over it."""
    resid = table(spark, {1: np.random.default_rng(6).normal(size=(60, NODES))}).repartition(4, "athlete")
    got = dependence.gram(resid, [], NODES, tile=4).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in got) == 60 * 60 and len(got) > 4


def test_products_of_both_orders_take_the_bytes_of_one(spark, tmp_path):
    """As a file, a row takes over 8 bytes where mirror images lie far apart."""
    resid = table(spark, {1: np.random.default_rng(7).normal(size=(700, NODES))})
    path = tmp_path / "gram"
    dependence.gram(resid, [], NODES, tile=256).write.option("compression", "snappy").parquet(str(path))
    assert spark.read.parquet(str(path)).count() == 700 * 700
    assert sum(f.stat().st_size for f in path.glob("*.parquet")) < 6 * 700 * 700


@pytest.mark.parametrize("limits", [(1 << 21, 1 << 28, 1024), (46, 1 << 28, 1024), (46, 300, 4), (10, 1000, 0)])
def test_blocks_do_not_change_the_test(spark, curves, monkeypatch, limits):
    resid = table(spark, curves)
    want = dependence.permutation_test(resid, [], NODES, 60, 7).first()
    for name, value in zip(("CELLS", "WORK", "DENSE"), limits, strict=True):
        monkeypatch.setattr(dependence, name, value)
    got = dependence.permutation_test_blas(resid, [], NODES, 60, 7).first()
    assert tuple(got) == pytest.approx(tuple(want), rel=1e-9)


def test_zero_norms_give_null(spark):
    still = table(spark, {1: np.zeros((6, NODES)), 2: np.zeros((3, NODES))})
    got = dependence.permutation_test_blas(still, [], NODES, 20, 7).first()
    assert got["rho"] is None and got["permutations"] == 20


def test_the_sum_without_one_place():
    d = np.array([3.0, 0.0, 1e-20, 0.1])
    assert dependence._without(d, np.arange(4)).tolist() == pytest.approx([0.1, 3.1, 3.1, 3.0])
    assert dependence._without(np.array([0.1, 0.0, 0.0]), np.array([0]))[0] == 0.0


def test_a_hundred_thousand_trials_in_one_group(spark):
    """Their Gram matrix would take 80 GB."""
    n, q = 100_000, 4
    resid = spark.range(n).select(F.lit(1).alias("athlete"), (F.col("id") + 1).alias("trial"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("node"))
    resid = resid.withColumn("r", F.sin(F.col("trial") * (F.col("node") + 1)))
    got = dependence.permutation_test_blas(resid, [], q, 20, 7).first()
    t = np.arange(1, n + 1)
    x, w = np.sin(t[:, None] * np.arange(1, q + 1)), np.asarray(weights(q))
    d = (x * x * w).sum(1)
    assert got["rho"] == pytest.approx(float((x[:-1] * x[1:] * w).sum() / np.sqrt(d[:-1].sum() * d[1:].sum())), rel=1e-9)
    assert abs(got["null_p975"]) < 0.02


def test_no_permutation_query_makes_products_of_all_pairs(spark, monkeypatch):
    from curvestat.plans import resampling as P

    def none(*a, **k):
        raise AssertionError("products of all pairs")

    monkeypatch.setattr(dependence, "gram", none)
    monkeypatch.setattr(dependence, "DENSE", 0)
    got = P.permutation_lag1(spark, "/root/testdata/sf0.001").first()
    assert got["permutations"] == 500 and 0 < got["p_value"] <= 1
