"""Replicate metrics, the two-way bootstrap of shares, AR(1) thresholds and permutation orders against plain computations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvestat.functions.arrays import node_weight, weights
from curvestat.operators import dependence, replicates, resampling


def test_thresholds_of_all_replicates_against_a_scan():
    rng = np.random.default_rng(1)
    b = np.where(rng.random((60, 9)) < 0.15, 0.0, rng.exponential(size=(60, 9)))
    w = rng.exponential(size=(60, 9)) * rng.choice([0.1, 1, 30], size=(60, 1))
    b[0], w[1], b[2] = 0, 0, 1
    weight = np.array(weights(9))
    for target in (0.5, 0.8, 0.9):
        got = replicates.pointwise_thresholds(b, w, weight, target, 700)
        for i in range(60):
            mean = lambda n: sum(g * (x / (x + y / n) if x + y / n > 0 else 0) for g, x, y in zip(weight, b[i], w[i], strict=True))  # noqa: B023, E731
            want = next((n for n in range(1, 701) if mean(n) >= target), np.inf)
            assert got[i] == want
    assert np.isinf(got).any() and np.isfinite(got).any()


def test_metric_table(spark, monkeypatch):
    monkeypatch.setattr(replicates, "TOGETHER", 2)
    rng = np.random.default_rng(2)
    b, w = rng.exponential(size=(5, 4)), rng.exponential(size=(5, 4))
    b[3] = 0
    rows = [("x", i, k, float(b[i, k]), float(w[i, k]), bool(b[i, k] > 0)) for i in range(5) for k in range(4)]
    components = spark.createDataFrame(rows, "m string, rep int, node int, sigma2_b double, sigma2_w double, interior boolean")
    out = {r["rep"]: r for r in replicates.metric_table(components, ["m", "rep"], 4).collect()}
    weight = np.array(weights(4))
    for i in range(5):
        big, within = b[i] @ weight, w[i] @ weight
        assert out[i]["B"] == pytest.approx(big) and out[i]["boundary_nodes"] == (4 if i == 3 else 0)
        for n in (1, 10, 50):
            assert out[i][f"R_L2_m{n}"] == pytest.approx(big / (big + within / n))
            assert out[i][f"mean_pointwise_reliability_m{n}"] == pytest.approx((b[i] / (b[i] + w[i] / n)) @ weight)
    assert out[3]["required_n_R_L2_90"] == out[3]["required_n_mean_pointwise_R_90"] == float("inf")


def two_way(x):
    """Components of an array athletes x actions x trials, by sums of squares about its means."""
    p, a, r = x.shape
    cell, athlete, action, grand = x.mean(2), x.mean((1, 2)), x.mean((0, 2)), x.mean()
    ms_p = a * r * ((athlete - grand) ** 2).sum() / (p - 1)
    ms_a = p * r * ((action - grand) ** 2).sum() / (a - 1)
    ms_i = r * ((cell - athlete[:, None] - action + grand) ** 2).sum() / ((p - 1) * (a - 1))
    ms_e = ((x - cell[:, :, None]) ** 2).sum() / (p * a * (r - 1))
    return [max(v, 0) for v in ((ms_a - ms_i) / (p * r), (ms_p - ms_i) / (a * r), (ms_i - ms_e) / r, ms_e)]


def test_two_way_replicates_are_fits_of_drawn_athletes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 3, 6, 4, 5)) + 100 + rng.normal(size=(1, 1, 6, 1, 1)) * 2
    rows = [(f"f{f}", n, p, a, 5, float(x[f, n, p, a].mean()), float(x[f, n, p, a].var() * 5)) for f in range(2) for n in range(3) for p in range(6) for a in range(4)]
    cells = spark.createDataFrame(rows, "family string, node int, athlete int, action int, r bigint, mean double, ss double")
    counts = lambda family, k: resampling.drawn_counts(7 + 1009 * int(family[1]), 8, k)
    boot = replicates.two_way_replicates(cells, counts, ["family", "node"], "family").cache()
    got = {(r["family"], r["node"], r["rep"]): [r[f"sigma2_{k}"] for k in ("action", "athlete", "action_athlete", "residual")] for r in boot.collect()}
    assert len(got) == 2 * 3 * 8 and (counts("f0", 6) != counts("f1", 6)).any()
    for (family, node, rep), values in got.items():
        drawn = np.repeat(np.arange(6), counts(family, 6)[rep - 1].astype(int))
        assert values == pytest.approx(two_way(x[int(family[1]), node, drawn]), abs=1e-9)
    table = {(r["family"], r["rep"]): r for r in replicates.share_table(boot, ["family"], node_weight(F.col("node"), 3)).collect()}
    a, p, i, e = np.array([got["f1", n, 4] for n in range(3)]).T @ np.array(weights(3))
    row = table["f1", 4]
    assert row["omega_athlete"] == pytest.approx(p / (a + p + i + e)) and row["all_cells_n10"] == pytest.approx((a + p + i) / (a + p + i + e / 10))
    assert row["athlete_across_actions_n50"] == pytest.approx(p / (p + i / 6 + e / 300)) and row["pooled_fixed_actions_n10"] == pytest.approx((p + i) / (p + i + e / 10))


def reliability(b, w, n, phi):
    d = 1 + 2 * sum((1 - k / n) * phi**k for k in range(1, n))
    return b / (b + w * d / n)


def test_first_ar1_is_the_first_for_correlations_of_either_sign(spark):
    """At -0.9 reliability falls from two trials to three, so a halved range would miss the first that suffices."""
    models = [(b, w, phi) for b, w in ((1.0, 3.0), (1.0, 2.1), (0.05, 1.0), (1.0, 0.01)) for phi in (-0.9, -0.5, -0.12, 0.0, 0.2, 0.9, 1.0)]
    got = {(r["b"], r["w"], r["phi"]): r["n"] for r in spark.createDataFrame(models, "b double, w double, phi double").select("*", dependence.first_ar1(F.col("b"), F.col("w"), F.col("phi"), 0.9, 400).alias("n")).collect()}
    for b, w, phi in models:
        assert got[b, w, phi] == next((n for n in range(1, 401) if reliability(b, w, n, phi) >= 0.9), float("inf"))
    assert got[1.0, 2.1, -0.9] == 2 and got[1.0, 3.0, 1.0] == float("inf")


def test_scenarios_hold_the_models_and_take_the_empirical_correlation(spark):
    models = spark.createDataFrame([(1, 2.0, 7.9), (2, 0.0, 1.0), (3, 1.0, 1.0)], "action int, B double, W double")
    empirical = spark.createDataFrame([(1, -0.2), (2, 0.1), (3, None)], "action int, rho double")
    out = dependence.ar1_scenarios(models, empirical, ["action"]).collect()
    assert len(out) == 15
    own = {r["action"]: r for r in out if r["scenario"] == "archive_order_lag1"}
    assert own[1]["phi"] == -0.2 and own[1]["required_n"] < 36 and own[1]["W_over_B"] == 3.95
    assert own[2]["required_n"] == float("inf") and own[2]["design_effect"] is None and own[2]["W_over_B"] is None
    assert own[3]["required_n"] is None
    assert [r["required_n"] for r in out if r["action"] == 1 and r["phi"] == 0.0] == [36.0]


def test_orders_are_the_same_in_numpy_and_columns(spark):
    values = [(7, rep, -3, t) for rep in (1, 2, 5000) for t in (0, 1, 2**40)]
    df = spark.createDataFrame(values, "a bigint, b bigint, c bigint, d bigint").select("*", resampling.mixed(*[F.col(x) for x in "abcd"]).alias("h"))
    for r in df.collect():
        assert int(resampling.mixed_matrix(*r[:4])) == r["h"]


def test_orders_look_random():
    """Each trial comes first about as often as any other, and neighbours aren't kept."""
    h = resampling.mixed_matrix(11, np.arange(20_000)[:, None], 3, np.arange(10)[None, :])
    order = np.argsort(h, axis=1)
    first = np.bincount(order[:, 0], minlength=10)
    assert abs(first - 2000).max() < 220
    assert abs((np.abs(np.diff(order, axis=1)) == 1).mean() - 0.2) < 0.01


def test_constant_curves_have_no_correlation(spark):
    nodes = spark.createDataFrame([(a, t, n, 1.0) for a in (1, 2) for t in (1, 2, 3) for n in range(4)], "athlete int, trial int, node int, y double")
    resid = dependence.residuals(nodes, [])
    for test in (dependence.permutation_test, dependence.permutation_test_blas):
        (row,) = test(resid, [], 4, 20, 1).collect()
        assert row["rho"] is None and row["permutations"] == 20
