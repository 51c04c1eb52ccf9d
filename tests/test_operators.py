from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvestat.operators import checks, components, curve_audit, influence, reml, resampling, reshape


def nodes_frame(spark, data):
    rows = [(a, t + 1, n, float(y)) for a, trials in enumerate(data) for t, curve in enumerate(trials) for n, y in enumerate(curve)]
    return spark.createDataFrame(rows, "athlete int, trial int, node int, y double")


def contrast_objective(lam, y, owner):
    """Profile deviance of the error contrasts K'y, K an orthonormal basis of what is orthogonal to the mean."""
    basis = np.linalg.svd(np.ones((1, len(y))))[2][1:]
    covariance = basis @ (np.eye(len(y)) + lam * (owner[:, None] == owner)) @ basis.T
    values, vectors = np.linalg.eigh(covariance)
    scaled = (vectors.T @ (basis @ y)) ** 2 / values
    return len(values) * np.log(scaled.mean()) + np.log(values).sum()


@pytest.mark.parametrize("seed", range(5))
def test_profile_is_the_likelihood_of_error_contrasts(seed):
    rng = np.random.default_rng(seed)
    owner = np.repeat(np.arange(6), rng.integers(2, 9, 6))
    y = rng.normal(size=len(owner)) + rng.normal(size=6)[owner] * seed
    n, s, z = (np.bincount(owner, w) for w in (None, y, y * y))
    for lam in (0.0, 0.03, 0.7, 25.0):
        # the basis drops the mean's own length, hence the logarithm of n
        assert reml.profile(np.array([lam]), n, s, z)[0][0] == pytest.approx(contrast_objective(lam, y, owner) + np.log(len(y)), abs=1e-9)


def test_one_way_boundary_and_reml(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(6, 8, 4))
    data[:, :, :2] += rng.normal(size=(6, 1, 2)) * 2
    frame = nodes_frame(spark, data)
    got = {r["node"]: r for r in components.one_way(frame, ["node"]).collect()}
    fit = {r["node"]: r for r in reml.unbalanced(reml.sufficient(frame, ["node"]), ["node"]).collect()}
    for k in range(4):
        means = data[:, :, k].mean(1)
        msb, msw = 8 * means.var(ddof=1), data[:, :, k].var(axis=1, ddof=1).mean()
        assert got[k]["msb"] == pytest.approx(msb) and got[k]["msw"] == pytest.approx(msw)
        if msb < msw:
            assert got[k]["sigma2_b"] == 0 and got[k]["sigma2_w"] == pytest.approx(data[:, :, k].var(ddof=1))
        assert fit[k]["sigma2_b"] == pytest.approx(got[k]["sigma2_b"], rel=1e-5, abs=1e-7)
        assert fit[k]["sigma2_w"] == pytest.approx(got[k]["sigma2_w"], rel=1e-5)
    assert any(r["interior"] for r in got.values())


def test_bootstrap_with_all_counts_one_is_the_point_estimate(spark):
    frame = nodes_frame(spark, np.random.default_rng(4).normal(size=(5, 6, 3)))
    cells = components.cell_statistics(frame, ["node"])
    ones = spark.createDataFrame([(1, a, 1) for a in range(5)], "rep int, athlete int, cnt bigint")
    boot = {r["node"]: r for r in resampling.bootstrap_components(cells, ones, ["node"]).collect()}
    blas = {r["node"]: r for r in resampling.blas_bootstrap(cells, lambda k: np.ones((1, k)), ["node"]).collect()}
    for r in components.one_way_from_cells(cells, ["node"]).collect():
        for other in (boot, blas):
            assert other[r["node"]]["sigma2_b"] == pytest.approx(r["sigma2_b"], abs=1e-12)
            assert other[r["node"]]["sigma2_w"] == pytest.approx(r["sigma2_w"])


def test_leave_one_out_by_subtraction(spark):
    rng = np.random.default_rng(6)
    frame = nodes_frame(spark, rng.normal(size=(5, 6, 3)) + 1000 + 3 * rng.normal(size=(5, 1, 1)))
    cells = components.cell_statistics(frame, ["node"])
    got = {(r["excluded"], r["node"]): r for r in influence.leave_one_out(cells, ["node"]).collect()}
    for a in range(5):
        for r in components.one_way_from_cells(cells.filter(F.col("athlete") != a), ["node"]).collect():
            other = got[a, r["node"]]
            assert (other["p"], other["m"]) == (4, 6) and other["sigma2_b"] == pytest.approx(r["sigma2_b"], abs=1e-9) and other["sigma2_w"] == pytest.approx(r["sigma2_w"], abs=1e-9)


def test_drawn_counts_are_the_draws(spark):
    groups = spark.createDataFrame([(i,) for i in range(7)], "athlete int")
    counts = resampling.drawn_counts(3, 9, 7)
    assert {(r["rep"], r["athlete"]): r["cnt"] for r in resampling.draws(spark, 9, groups, 3).collect()} == {(i + 1, j): n for i, row in enumerate(counts) for j, n in enumerate(row) if n}


def test_pointwise_trials_beyond_a_million(spark):
    from curvestat.functions import reliability

    t = spark.createDataFrame([([1.0, 1.0], [5e7, 5e7]), ([1.0, 0.0], [1.0, 1.0])], "b array<double>, w array<double>")
    asked = lambda *most: [r[0] for r in t.select(reliability.required_pointwise(F.col("b"), F.col("w"), 0.9, *most)).collect()]
    assert asked(1 << 52) == [pytest.approx(4.5e8, rel=1e-6), float("inf")]
    assert asked() == [float("inf")] * 2


def test_profile_fit_of_a_node_with_a_million_groups(spark):
    """The fit of balanced groups has a closed form; groups are summed where they lie."""
    groups, m = 1_000_000, 4
    g = spark.range(0, groups, 1, 8).select(F.col("id").alias("athlete"), F.lit(3).alias("node"), F.lit(m).cast("bigint").alias("n"), *[F.randn(i).alias(c) for i, c in enumerate("uev")])
    s, within = m * 1.5 * F.col("u") + 2.0 * F.col("e"), 3.0 + 0.5 * F.col("v")
    stats = g.select("athlete", "node", "n", s.alias("s"), (s * s / m + within).alias("z")).cache()
    means = stats.agg((F.var_samp(F.col("s") / m) * m).alias("msb"), (F.sum(F.col("z") - F.col("s") * F.col("s") / m) / (groups * (m - 1))).alias("msw")).first()
    (fit,) = reml.unbalanced(stats, ["node"]).collect()
    assert fit["interior"] and fit["converged"] and not fit["upper_warning"]
    assert fit["sigma2_w"] == pytest.approx(means["msw"], rel=1e-6) and fit["sigma2_b"] == pytest.approx((means["msb"] - means["msw"]) / m, rel=1e-6)
    plan = reml.unbalanced(stats.limit(100), ["node"])._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_profile_fit_of_nodes_under_several_keys(spark):
    rng = np.random.default_rng(8)
    rows = [(c, k, a, float(n), float(rng.normal() * n + (5 if k == 2 else 0.1) * n * rng.normal()), 0.0) for c in (None, "x") for k in (1, 2) for a, n in enumerate(rng.integers(2, 9, 40))]
    rows = [(c, k, a, n, s, s * s / n + float(rng.chisquare(n - 1))) for c, k, a, n, s, _ in rows]
    stats = spark.createDataFrame(rows, "c string, node int, athlete int, n double, s double, z double")
    fits = {(r["c"], r["node"]): r for r in reml.unbalanced(stats, ["c", "node"]).collect()}
    assert len(fits) == 4
    for (c, k), fit in fits.items():
        own = np.array([r[3:] for r in rows if r[:2] == (c, k)]).T
        theta = np.linspace(-20, 20, 40001)
        best = theta[reml.profile(np.exp(theta), *own)[0].argmin()]
        assert fit["lam"] == pytest.approx(np.exp(best), rel=2e-3)


def test_draws_take_as_many_groups_as_there_are(spark):
    groups = spark.createDataFrame([(i,) for i in range(7)], "athlete int")
    got = resampling.draws(spark, 9, groups, 1).groupBy("rep").agg(F.sum("cnt").alias("n")).collect()
    assert len(got) == 9 and all(r["n"] == 7 for r in got)


def test_percentile_summary_without_finite_values(spark):
    t = spark.createDataFrame([(1.0, float("inf")), (3.0, float("inf"))], "a double, b double")
    got = {r["metric"]: r for r in resampling.percentile_summary(t, [], ["a", "b"]).collect()}
    assert got["a"]["mean"] == 2.0 and got["a"]["infinite_fraction"] == 0.0
    assert got["b"]["mean"] == float("inf") and got["b"]["infinite_fraction"] == 1.0


def test_runs_and_structural_curve(spark):
    zero = {(0, 1), (1, 1), (4, 1), (2, 2)}
    rows = [(1, f, j, *((0.0, 0.0, 0.0) if (f, j) in zero else (float(f), 1.0, 0.0))) for f in range(5) for j in (1, 2)]
    joints = spark.createDataFrame(rows, "trial int, frame int, joint int, x double, y double, z double")
    runs = {(r["joint"], r["first"]): (r["last"], r["run_length"], r["touches_start"], r["touches_end"]) for r in curve_audit.zero_runs(joints, ["trial"]).collect()}
    assert runs == {(1, 0): (1, 2, True, False), (1, 4): (4, 1, False, True), (2, 2): (2, 1, False, False)}
    curve = {r["step"]: (r["moved"], r["valid_joints"]) for r in curve_audit.structural_body_curve(curve_audit.steps(joints, ["trial"]), ["trial"]).collect()}
    assert curve[0] == (1.0, 1) and curve[1] == (None, 0) and curve[3] == (1.0, 1)
    with pytest.raises(ValueError):
        curve_audit.to_joints(joints, ["trial"], "x", 14, (15,))


def test_explode_lists(spark):
    good = spark.createDataFrame([(1, "2;5", "a;b"), (2, "", "")], "k int, l string, r string")
    assert sorted(map(tuple, reshape.explode_lists(good, ["k"], "l", "r").collect())) == [(1, "2", "a"), (1, "5", "b")]
    with pytest.raises(Exception, match="differ in length"):
        reshape.explode_lists(spark.createDataFrame([(1, "2;5", "a")], "k int, l string, r string"), ["k"], "l", "r").collect()


def test_duplicate_choice(spark):
    rows = [(1, "x", 3), (2, "x", 31), (3, "y", 5), (4, "y", 5), (5, "z", 35), (6, "z", 33), (7, "w", 1)]
    members = influence.duplicate_groups(spark.createDataFrame(rows, "i int, key string, p int"), "key")
    got = {r["i"]: r["quarantined"] for r in influence.duplicate_removals(members, "p", "i", 30).collect()}
    assert got == {2: True, 4: False, 5: False}


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, c string")
    assert [tuple(r) for r in checks.key_differences(df, checks.full_product(df, ["k", "c"]), ["k", "c"]).collect()] == [(2, "b", "missing")]
    with pytest.raises(ValueError):
        checks.require_empty(checks.row_count(df, 2), "rows")
    with pytest.raises(ValueError):
        checks.require_counts(replicates=0)
