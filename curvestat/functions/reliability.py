"""Column expressions on variance components: reliability and trial counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvestat.functions.arrays import integral, let

GRID = (1, 2, 5, 10, 15, 20, 30, 40, 50)
TARGETS = (0.8, 0.9)
INFINITY = float("inf")
#: Largest number of trials that the pointwise threshold looks at; up to 1 << 52 whole numbers are exact doubles.
MOST_TRIALS = 1_000_000


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b as floating-point arithmetic and the SQL of the queries have it where b is 0: infinity with the sign of a, not a number for 0 / 0."""
    a = a.cast("double")
    zero = F.when(a.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(INFINITY)).otherwise(F.lit(-INFINITY))
    return F.when(b == 0, zero).otherwise(a / b)


def reliability(b: Column, w: Column, n: Column) -> Column:
    return safe_ratio(b, b + w / n)


def mean_pointwise(bs: Column, ws: Column, n: Column) -> Column:
    """Phase mean of the reliability curve of n trials, from arrays of components."""
    return integral(F.zip_with(bs, ws, lambda b, w: reliability(b, w, n)))


def continuous_trials(b: Column, w: Column, target: float) -> Column:
    return F.when(b > 0, target * w / ((1 - target) * b)).otherwise(F.lit(INFINITY))


def _whole(x: Column) -> Column:
    """x rounded up, 1 at least. Rounding up makes a long, where not a number would be 0, so it stays, as do numbers from 1 << 52 on, which are whole."""
    return F.greatest(F.lit(1.0), F.when(F.isnan(x) | (x >= float(1 << 52)), x).otherwise(F.ceil(x).cast("double")))


def plain_required_trials(b: Column, w: Column, target: float) -> Column:
    """Smallest whole number not below the continuous threshold, at least 1."""
    return F.when(b > 0, _whole(target * w / ((1 - target) * b))).otherwise(F.lit(INFINITY))


def required_trials(b: Column, w: Column, target: float) -> Column:
    """As plain_required_trials, one unit in the last place lower before rounding up."""
    x = target * w / ((1 - target) * b) * F.lit(0.9999999999999999)
    return F.when(b > 0, _whole(x)).otherwise(F.lit(INFINITY))


def required_pointwise(bs: Column, ws: Column, target: float, most: int = MOST_TRIALS) -> Column:
    """Smallest n up to ``most`` whose mean pointwise reliability reaches the target; infinity if none does."""
    attainable = integral(F.transform(bs, lambda b: F.when(b > 0, 1.0).otherwise(0.0)))
    reaches = lambda n: mean_pointwise(bs, ws, n.cast("double")) >= target
    first = F.struct(F.lit(1).cast("bigint").alias("lo"), F.lit(most).cast("bigint").alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        return let(mid, lambda m: F.when(acc["lo"] >= acc["hi"], acc).when(reaches(m), F.struct(acc["lo"].alias("lo"), m.alias("hi"))).otherwise(F.struct((m + 1).alias("lo"), acc["hi"].alias("hi"))))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length() + 1)), first, halve)["lo"]
    reachable = (attainable + 1e-14 >= target) & (mean_pointwise(bs, ws, F.lit(float(most))) >= target)
    return F.when(reachable, found.cast("double")).otherwise(F.lit(INFINITY))


def ar1_design_effect(n: Column, phi: Column) -> Column:
    """1 + 2 sum over k < n of (1 - k / n) phi^k, in closed form; n where phi is 1."""
    tail = phi / (1 - phi) - phi * (1 - F.pow(phi, n)) / (n * (1 - phi) * (1 - phi))
    return F.when(n <= 1, F.lit(1.0)).when(phi == 1, n).otherwise(1 + 2 * tail)


def ar1_reliability(b: Column, w: Column, n: Column, phi: Column) -> Column:
    return safe_ratio(b, b + w * ar1_design_effect(n, phi) / n)
