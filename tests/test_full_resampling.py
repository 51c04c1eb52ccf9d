from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from curvestat.plans import resampling as P

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_queries_run_at_the_counts_of_the_reference(spark, monkeypatch):
    asked, draws = [], P.resampling.draws
    monkeypatch.setattr(P.resampling, "draws", lambda spark, reps, *a: asked.append(reps) or draws(spark, reps, *a))
    for f in (P.bca_interval, P.bootstrap_bands, P.bootstrap_percentiles, P.bootstrap_diagnostics, P.paired_contrasts):
        f(spark, DIR)
    assert asked == [5000] * 5
    assert P.bootstrap_diagnostics(spark, DIR).first()["replicates"] == 5000
    assert P.balanced_subsample(spark, DIR).agg(F.max("rep")).first()[0] == 1000
    assert P.permutation_lag1_blas(spark, DIR).first()["permutations"] == 5000


def test_subsample_cells_give_the_subsamples_of_the_windows(spark):
    got, want = (sorted(map(tuple, f.collect())) for f in (P.balanced_subsample(spark, DIR, 5), P.window_subsample(spark, DIR, 5)))
    assert len(got) == len(want) == 5
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-8)
