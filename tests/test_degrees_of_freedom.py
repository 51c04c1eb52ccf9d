"""Designs of one trial in the smallest cell or of one group: their mean squares have no degrees of freedom."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvestat.catalog import CORE
from curvestat.functions import reliability as R
from curvestat.operators import components as C
from curvestat.operators import resampling
from curvestat.plans import load_all

load_all()


def same(a, b):
    return all(x == pytest.approx(y, abs=1e-5, nan_ok=True) for x, y in zip(a, b, strict=True))


def test_events_with_one_trial_in_a_cell_give_the_rows_of_the_sql(spark, tmp_path):
    import duckdb

    # user 3 has one event of type 1, all others two or three of each
    rows = [(u, k, t) for u in range(4) for k in range(3) for t in range(1 if (u, k) == (3, 1) else 2 + (u + k) % 2)]
    e = spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}", u, f"type{k}", float((7 * i) % 11 + u)) for i, (u, k, _) in enumerate(rows)], "event_id bigint, ts string, user_id bigint, event_type string, value double")
    e.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = CORE.builders["scalar_two_way_events"](spark, str(tmp_path)).collect(), con.sql(CORE.oracles["scalar_two_way_events"]).fetchall()
    assert len(got) == len(want) == 1 and same(tuple(got[0]), want[0])
    assert want[0][2] == 1 and math.isnan(want[0][5])


def test_one_trial_of_each_group(spark):
    nodes = spark.createDataFrame([(a, 0, float(a * a)) for a in range(4)], "athlete int, node int, y double")
    got = C.one_way(nodes, ["node"]).first()
    # not a number is above all numbers, so the model is at its boundary and all is pooled
    assert math.isnan(got["msw"]) and not got["interior"] and got["sigma2_b"] == 0
    assert got["sigma2_w"] == pytest.approx(got["ssb"] / 3)


def test_two_way_replicates_of_one_trial(spark):
    cells = spark.createDataFrame([(0, a, k, 1, float(a * k + a), 0.0) for a in range(3) for k in range(2)], "node int, athlete int, action int, r bigint, mean double, ss double")
    drawn = resampling.draws(spark, 3, cells.select("athlete"), 1)
    for r in resampling.bootstrap_two_way(cells, drawn, ["node"]).collect():
        assert math.isnan(r["sigma2_residual"])


def test_ratio(spark):
    row = spark.range(1).select(*[R.ieee_ratio(F.lit(a).cast("double"), F.lit(b)).alias(str(i)) for i, (a, b) in enumerate([(1, 2), (1, 0), (-1, 0), (0, 0), (float("nan"), 0), (None, 0)])]).first()
    assert tuple(row)[:3] == (0.5, math.inf, -math.inf) and math.isnan(row[3]) and math.isnan(row[4]) and row[5] is None


@pytest.mark.parametrize("name", ["estimand_comparison", "required_trials"])
def test_thresholds_of_one_group_are_those_of_the_sql(spark, tmp_path, name):
    import duckdb

    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(size=64)], 1) for i in range(12)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, rel = CORE.builders[name](spark, str(tmp_path)), con.sql(CORE.oracles[name])
    want = rel.fetchall()[0]
    assert same([got.first()[c] for c in rel.columns], want)
    assert math.isnan(want[rel.columns.index("required_90" if name == "required_trials" else "required_n_R_L2_90")])


def test_thresholds_beyond_the_longs(spark):
    row = spark.range(1).select(*[f(F.lit(b), F.lit(w), 0.9) for b, w in [(1e-30, 1.0), (2.0**-60, 1.0), (float("nan"), 1.0)] for f in (R.required_trials, R.plain_required_trials)]).first()
    assert tuple(row)[:4] == pytest.approx((9e30, 9e30, 9 * 2.0**60, 9 * 2.0**60)) and math.isnan(row[4]) and math.isnan(row[5])


@pytest.mark.parametrize("n", [0, 1, 12])
def test_pointwise_thresholds_of_few_curves_are_those_of_the_sql(spark, tmp_path, n):
    import duckdb

    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(size=64)], i % 2) for i in range(n)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = CORE.builders["required_trials_pointwise"](spark, str(tmp_path)).select("target", "required").collect()
    want = con.sql(CORE.oracles["required_trials_pointwise"]).fetchall()
    assert len(want) == (4 if n else 0) and sorted(map(tuple, got)) == sorted(want)
