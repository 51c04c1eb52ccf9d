from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvestat.operators import components as C
from curvestat.operators import resampling
from curvestat.operators import variants as V

VARIANTS = {"all14": ((1, 2, 3, 4), 3), "fixed2": ((1, 3), 2)}
NODES, FRAMES = 7, 9


@pytest.fixture(scope="module")
def joints():
    """(athlete, trial, frame, joint, x, y, z): joint 2 is lost now and then, joints 2 and 4 together in one trial; one step is far too large."""
    draw, rows = random.Random(3), []
    for athlete in range(4):
        for trial in range(5):
            for frame in range(FRAMES):
                for joint in range(1, 5):
                    at = [draw.gauss(0, 1) + frame for _ in range(3)]
                    if (athlete, trial) == (1, 2) and frame == 5:
                        at = [x + 80 for x in at]
                    lost = joint == 2 and draw.random() < 0.1 or (athlete, trial, frame) == (3, 4, 4) and joint in (2, 4)
                    rows.append((athlete, trial, frame, joint, *([0.0] * 3 if lost else at)))
    return rows


@pytest.fixture(scope="module")
def frames(spark, joints):
    return spark.createDataFrame(joints, "athlete int, trial int, frame int, joint int, x double, y double, z double")


def brute(joints):
    """xs and fewest joints by (variant, athlete, trial)."""
    at = {(a, t, f, j): np.array(p) for a, t, f, j, *p in joints}
    out = {}
    for name, (chosen, _) in VARIANTS.items():
        for a, t in {(a, t) for a, t, *_ in joints}:
            xs, fewest = [], 99
            for f in range(FRAMES - 1):
                moved = [float(np.linalg.norm(at[a, t, f + 1, j] - at[a, t, f, j])) for j in chosen if at[a, t, f, j].any() and at[a, t, f + 1, j].any()]
                xs.append(statistics.fmean(moved) if moved else None)
                fewest = min(fewest, len(moved))
            out[name, a, t] = xs, fewest
    return out


def hampel(xs, radius=5, z=8.0, ratio=4.0):
    flags = []
    for i, x in enumerate(xs):
        near = xs[max(0, i - radius) : i] + xs[i + 1 : i + 1 + radius]
        m = statistics.median(near)
        flags.append(x > max(m + z * 1.4826 * statistics.median(abs(v - m) for v in near), ratio * m))
    good = [i for i, f in enumerate(flags) if not f]
    return [float(np.interp(i, good, [xs[k] for k in good])) for i in range(len(xs))], flags


def test_curves_of_every_variant(spark, joints, frames):
    steps = V.body_steps(frames, ["athlete", "trial"], VARIANTS)
    got = {(r["variant"], r["athlete"], r["trial"]): r for r in V.curves(steps, NODES, VARIANTS).collect()}
    want = brute(joints)
    assert set(got) == set(want) | {("hampel", a, t) for name, a, t in want if name == "all14"}
    short = {(r["variant"], r["athlete"], r["trial"]) for r in V.short_of_joints(steps, VARIANTS).collect()}
    assert short == {k for k, (_, fewest) in want.items() if fewest < VARIANTS[k[0]][1]} and ("all14", 3, 4) in short
    for k, (xs, fewest) in want.items():
        assert got[k]["fewest"] == fewest
        if k in short:
            assert got[k]["y"] is None
            continue
        grid = np.linspace(0, len(xs) - 1, NODES)
        assert got[k]["y"] == pytest.approx(np.interp(grid, range(len(xs)), xs))
        if k[0] == "all14":
            fixed, flags = hampel(xs)
            assert got["hampel", *k[1:]]["flags"] == flags and got["hampel", *k[1:]]["y"] == pytest.approx(np.interp(grid, range(len(xs)), fixed))
    assert any(got["hampel", 1, 2]["flags"]) and got["hampel", 3, 4]["y"] is None


def test_influence_under_both_rules(spark, joints, frames):
    curved = V.curves(V.body_steps(frames.filter("athlete < 3"), ["athlete", "trial"], VARIANTS), NODES, VARIANTS).cache()
    cells = V.cells(curved)
    left = {(r["quality_rule"], r["excluded"]): r for r in V.leave_one_out(cells, NODES).collect()}
    for rule, variant in V.RULES.items():
        for athlete in range(3):
            rest = curved.filter((F.col("variant") == variant) & (F.col("athlete") != athlete))
            one = V.fits(V.cells(rest), NODES).collect()
            assert len(one) == 1
            for name in ("B", "W", "required_n_R_L2_90"):
                assert left[rule, athlete][name] == pytest.approx(one[0][name])
    shares = V.contributions(cells, NODES).groupBy("quality_rule").agg(F.sum("within_share").alias("w"), F.count("*").alias("n")).collect()
    assert len(shares) == 2 and all(r["w"] == pytest.approx(1) and r["n"] == 3 for r in shares)


def test_subsamples_of_cells_of_two_columns(spark):
    draw = random.Random(8)
    rows = [(a, c, t, [draw.gauss(a, 1) for _ in range(3)]) for a in range(4) for c in range(2) for t in range(1, 5 + a + c)]
    trials = spark.createDataFrame(rows, "athlete int, action int, trial int, y array<double>")
    least = trials.groupBy("athlete", "action").count().groupBy("action").agg(F.min("count").alias("least"))
    sized = trials.join(least, "action")
    got = {(r["rep"], r["athlete"], r["action"], r["node"]): r for r in resampling.subsample_cells(sized, 20, 7, F.col("least"), also=("action",)).collect()}
    plain = resampling.subsample(sized, 20, 7, ["athlete", "action"], "trial", F.col("least"))
    points = plain.select("rep", "action", "athlete", F.posexplode("y").alias("node", "y"))
    want = C.cell_statistics(points, ["rep", "action", "node"]).collect()
    assert len(want) == len(got) == 20 * 8 * 3
    for r in want:
        g = got[r["rep"], r["athlete"], r["action"], r["node"]]
        assert (g["n"], g["mean"], g["ss"]) == (r["n"], pytest.approx(r["mean"]), pytest.approx(r["ss"], abs=1e-9))
