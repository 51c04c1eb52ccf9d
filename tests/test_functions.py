from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvestat.functions import arrays as A
from curvestat.functions import reliability as R


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_weights():
    assert A.weights(5) == [0.125, 0.25, 0.25, 0.25, 0.125]
    with pytest.raises(ValueError):
        A.weights(1)


def test_reliability_and_thresholds(spark):
    b, w = F.lit(2.0), F.lit(8.0)
    row = one(spark, R.reliability(b, w, F.lit(4.0)), R.required_trials(b, w, 0.8), R.required_trials(F.lit(0.0), w, 0.8), R.required_trials(b, F.lit(0.0), 0.8), R.reliability(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert row[0] == 0.5 and row[1] == 16.0 and math.isinf(row[2]) and row[3] == 1.0 and row[4] == 0.0


def test_pointwise_threshold_is_minimal(spark):
    bs, ws = [0.5, 1.0, 2.0], [1.0, 2.0, 3.0]
    n = one(spark, R.required_pointwise(arr(bs), arr(ws), 0.9))[0]
    w = np.array(A.weights(3))
    f = lambda k: float((w * (np.array(bs) / (np.array(bs) + np.array(ws) / k))).sum())
    assert f(n) >= 0.9 > f(n - 1)
    assert math.isinf(one(spark, R.required_pointwise(arr([0, 0, 2]), arr(ws), 0.9))[0])


@pytest.mark.parametrize("phi", [0.0, 0.1, 0.3, 0.7])
def test_design_effect(spark, phi):
    for n in (1, 2, 7, 50):
        direct = 1 + 2 * sum((1 - k / n) * phi**k for k in range(1, n))
        assert one(spark, R.ar1_design_effect(F.lit(float(n)), F.lit(phi)))[0] == pytest.approx(direct, abs=1e-12)


def test_phase_normalise(spark):
    y = [1.0, 4.0, 2.0, 8.0, 5.0]
    same, finer, short, bad = one(spark, A.phase_normalise(arr(y), 5), A.phase_normalise(arr(y), 17), A.phase_normalise(arr([1.0]), 5), A.phase_normalise(arr([1.0, float("nan")]), 5))
    assert same == pytest.approx(y)
    assert finer == pytest.approx(np.interp(np.linspace(0, 1, 17), np.linspace(0, 1, 5), y))
    assert short is None and bad is None


def test_moving_average_and_peak(spark):
    y = list(np.random.default_rng(1).random(30))
    padded = np.pad(y, 5, mode="edge")
    expected = np.convolve(padded, np.ones(11) / 11, mode="valid")
    lo, hi = A.search_range(30, 10, 90)
    got, at = one(spark, A.moving_average_nearest(arr(y), 11), A.peak(arr([0, 9, 1, 5, 5, 2, 0, 0, 0, 9]), 2, 7))
    assert got == pytest.approx(expected) and at == 3 and (lo, hi) == (3, 26)
    with pytest.raises(ValueError):
        A.moving_average_nearest(arr(y), 4)
    with pytest.raises(ValueError):
        A.search_range(30, 0, 90)


def test_warp_moves_the_peak(spark):
    y = [0.0, 1.0, 4.0, 1.0, 0.0, 0.0, 0.0]
    got = one(spark, A.warp(arr(y), F.lit(2.0), F.lit(3.0), 7))[0]
    assert int(np.argmax(got)) == 3 and got[0] == 0.0 and got[-1] == 0.0
    assert one(spark, A.warp(arr(y), F.lit(2.0), F.lit(2.0), 7))[0] == pytest.approx(y)


def hampel(y, radius=5, z=8.0, ratio=4.0):
    eps, out = np.finfo(float).eps, []
    for i, v in enumerate(y):
        ref = [y[j] for j in range(max(0, i - radius), min(len(y), i + radius + 1)) if j != i]
        if len(ref) < 4:
            out.append(False)
            continue
        m = np.median(ref)
        mad = np.median(np.abs(np.array(ref) - m))
        out.append(bool(v > max(m + z * max(1.4826 * mad, eps), ratio * max(m, eps))))
    return out


def test_hampel(spark):
    y = [1.0, 1.1, 0.9, 1.0, 30.0, 1.05, 0.95, 1.0, 1.0, 50.0]
    flags = A.hampel_flags(arr(y))
    got, fixed, lists = one(spark, flags, A.repair(arr(y), flags), F.struct(*A.serialise_flags(flags)))
    assert got == hampel(y) and got[4] and got[9]
    assert fixed[4] == pytest.approx((1.0 + 1.05) / 2) and fixed[9] == 1.0
    assert lists[0] == "4;9" and lists[1] == "44.444444;100.000000"
    assert one(spark, A.hampel_flags(arr([1, 1, 99])))[0] == [False] * 3


def test_halving_and_padding(spark):
    half, kept, prefix, zero = one(spark, A.halved(arr([1, 2, 1, 2]), 2), A.halved(arr([1, 2, 1, 3]), 2), A.observable(arr([1, 2, 3]), F.lit(2), 3), A.tail_is_zero(arr([1, 2, 0]), F.lit(2)))
    assert half == [1.0, 2.0] and len(kept) == 4 and prefix == [1.0, 2.0] and zero


def test_normal_functions(spark):
    from curvestat.functions.distributions import normal_cdf, normal_quantile

    got = spark.createDataFrame([(0.975,)], "p double").select(normal_quantile("p").alias("z")).select("z", normal_cdf("z")).first()
    assert got[0] == pytest.approx(1.959963984540054) and got[1] == pytest.approx(0.975)
