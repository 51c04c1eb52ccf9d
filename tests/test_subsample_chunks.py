"""Balanced subsamples from chunks of a cell's curves and from blocks of replicates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvestat.operators import resampling

REPS = 6


@pytest.fixture(scope="module")
def trials(spark):
    """Two athletes of 40 and 25 trials, and rows without an athlete; curves far from zero."""
    rng = np.random.default_rng(3)
    rows = [(a, t + 1, (1e6 + rng.normal(size=4)).tolist()) for a, n in ((1, 40), (2, 25), (None, 30)) for t in range(n)]
    return spark.createDataFrame(rows, "athlete int, trial int, y array<double>").withColumn("least", F.lit(20))


@pytest.mark.parametrize("limits", [(4096, 1 << 19, 16), (7, 64, 4), (1, 1, 16)])
def test_chunks_and_blocks_do_not_change_the_subsamples(spark, trials, monkeypatch, limits):
    for name, value in zip(("CHUNK", "HASHES", "PARTS"), limits, strict=True):
        monkeypatch.setattr(resampling, name, value)
    got = resampling.subsample_cells(trials, REPS, 5, F.col("least"))
    assert got.columns == ["rep", "athlete", "node", "n", "mean", "ss"]
    rows = {(r["rep"], r["athlete"], r["node"]): r for r in got.collect()}
    assert len(rows) == got.count() == REPS * 3 * 4
    chosen = resampling.subsample(trials.filter("athlete IS NOT NULL"), REPS, 5, ["athlete"], "trial", F.col("least"))
    want = chosen.select("rep", "athlete", F.posexplode("y").alias("node", "v")).groupBy("rep", "athlete", "node").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("v")).collect()
    assert len(want) == REPS * 2 * 4
    for w in want:
        r = rows[w["rep"], w["athlete"], w["node"]]
        assert r["n"] == w["n"] == 20
        assert r["mean"] == pytest.approx(w["mean"], rel=1e-12) and r["ss"] == pytest.approx(w["v"] * 20, rel=1e-6)
