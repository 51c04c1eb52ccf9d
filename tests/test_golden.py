"""Published values, re-derived from published components."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curvestat.functions import reliability as R
from curvestat.operators import components, dependence

#: Waveform, action, B, W, trials at 0.80 and 0.90, reliability of 10 trials.
MODELS = [
    ("racket", 1, 56.5458050243, 36.7401809084, 3, 6, 0.93898988903),
    ("racket", 2, 183.267533786, 138.580262376, 4, 7, 0.929699495916),
    ("racket", 3, 17.4789193246, 15.0268038799, 4, 8, 0.920834892172),
    ("racket", 4, 26.3090746906, 48.4837028271, 8, 17, 0.844391275123),
    ("racket", 5, 72.7581566378, 212.797927209, 12, 27, 0.773710583164),
    ("racket", 6, 16.4099177184, 18.1538575032, 5, 10, 0.900392015231),
    ("body", 1, 1.15407606978, 0.66508958926, 3, 6, 0.945510589298),
    ("body", 2, 4.68702630965, 2.82358372244, 3, 6, 0.943180415621),
    ("body", 3, 1.43168409255, 0.524869247047, 2, 4, 0.964635527783),
    ("body", 4, 0.647799838555, 0.458099577946, 3, 7, 0.933954280871),
    ("body", 5, 1.41023825668, 1.23882356894, 4, 8, 0.919248619829),
    ("body", 6, 1.10118121085, 0.425853694245, 2, 4, 0.96276742986),
]


@pytest.fixture(scope="module")
def models(spark):
    return spark.createDataFrame(MODELS, "waveform string, action int, B double, W double, n80 int, n90 int, r10 double")


def test_thresholds_and_reliability(models):
    b, w = F.col("B"), F.col("W")
    for r in models.select("n80", "n90", "r10", R.required_trials(b, w, 0.8).alias("a"), R.required_trials(b, w, 0.9).alias("c"), R.reliability(b, w, F.lit(10.0)).alias("r")).collect():
        assert (r["a"], r["c"]) == (r["n80"], r["n90"]) and r["r"] == pytest.approx(r["r10"], abs=1e-11)


def test_serial_dependence(models):
    racket5 = models.filter("waveform = 'racket' AND action = 5").select("B", "W")
    got = {r["phi"]: r["required_n"] for r in dependence.ar1_thresholds(racket5, [], dependence.PHIS).collect()}
    assert got == {0.0: 27.0, 0.1: 32.0, 0.2: 40.0, 0.3: 49.0}


def test_global_context(spark):
    parts = (63.7164383434787, 3.0168803000061137, 59.35406333387563, 78.29712245051495)
    one = spark.range(1).select(*[F.lit(v).alias(f"I_{k}") for k, v in zip(components.PARTS, parts, strict=True)])
    got = {r["trials_per_cell"]: r for r in components.global_design_study(one).collect()}
    assert got[1]["all_cells"] == pytest.approx(0.6169126291169251) and got[1]["athlete_across_actions"] == pytest.approx(0.11621826659166537)
    assert got[50]["pooled_fixed_actions"] == pytest.approx(0.9755079963234351) and got[50]["all_cells"] == pytest.approx(0.9877328502328703)


def test_flagship_query(spark):
    import os

    from curvestat.catalog import CORE
    from curvestat.plans import load_all

    load_all()
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    r = CORE.builders["oneway_components_embedding"](spark, "/root/testdata/sf0.01").first()
    assert (r["boundary_nodes"], r["B"], r["W"], r["reliability_10"]) == (33, pytest.approx(5.7381e-05, abs=1e-9), pytest.approx(0.015576849, abs=1e-9), pytest.approx(0.035528416, abs=1e-9))
