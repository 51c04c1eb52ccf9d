"""Column expressions on curves held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def let(value: Column, body) -> Column:
    """Evaluate value once and use it in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def norm(parts: list[Column]) -> Column:
    squares = parts[0] * parts[0]
    for p in parts[1:]:
        squares = squares + p * p
    return F.sqrt(squares)


def displacement(xs: Column) -> Column:
    """Absolute first differences; n values give n - 1 steps."""
    return F.when(F.size(xs) < 2, F.array().cast("array<double>")).otherwise(
        F.zip_with(F.slice(xs, F.lit(2), F.size(xs) - 1), F.slice(xs, F.lit(1), F.size(xs) - 1), lambda b, a: F.abs(b - a))
    )


def weights(q: int) -> list[float]:
    """Trapezoid weights of q equally spaced nodes on [0, 1]; they sum to 1."""
    if q < 2:
        raise ValueError("at least two nodes are needed")
    inner = 1.0 / (q - 1)
    return [inner / 2, *[inner] * (q - 2), inner / 2]


def node_weight(node: Column, q: int) -> Column:
    return F.when((node == 0) | (node == q - 1), 0.5 / (q - 1)).otherwise(1.0 / (q - 1))


def integral(xs: Column) -> Column:
    """Trapezoid integral of a curve over [0, 1], for any number of nodes from two."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    ends = lambda v: F.get(v, F.lit(0)) + F.get(v, F.size(v) - 1)
    return let(xs, lambda v: (total(v) - ends(v) / 2) / (F.size(v) - 1))


def inner_product(xs: Column, ys: Column) -> Column:
    return integral(F.zip_with(xs, ys, lambda a, b: a * b))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(xs: Column) -> Column:
    return F.forall(xs, finite)


def at_position(xs: Column, pos: Column) -> Column:
    """Linear interpolation of a curve at a fractional index."""
    lo = F.least(F.floor(pos).cast("int"), F.size(xs) - 2)
    return F.get(xs, lo) * (1 - (pos - lo)) + F.get(xs, lo + 1) * (pos - lo)


def phase_normalise(xs: Column, nodes: int) -> Column:
    """Linear interpolation to equally spaced nodes; null for fewer than two or non-finite values."""
    ok = (F.size(xs) >= 2) & all_finite(xs)
    grid = F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda j: at_position(xs, j * (F.size(xs) - 1) / F.lit(float(nodes - 1))))
    return F.when(ok, grid)


def moving_average_nearest(xs: Column, window: int) -> Column:
    """Centred moving average; edges are continued with the edge value, so every mean is over window values."""
    if window < 3 or window % 2 == 0:
        raise ValueError("the window must be odd and at least 3")
    half, last = window // 2, F.size(xs) - 1
    return F.transform(
        xs, lambda x, i: F.aggregate(F.sequence(i - half, i + half), F.lit(0.0), lambda acc, k: acc + F.get(xs, F.greatest(F.lit(0), F.least(last, k)))) / window
    )


def search_range(nodes: int, low_pct: float, high_pct: float) -> tuple[int, int]:
    """Nodes ceil(low * (q - 1)) to floor(high * (q - 1)) of a landmark search strictly inside the curve."""
    import math

    if not 0 < low_pct < high_pct < 100:
        raise ValueError("the search interval must lie strictly inside (0, 100)")
    return math.ceil(low_pct / 100 * (nodes - 1)), math.floor(high_pct / 100 * (nodes - 1))


def peak(xs: Column, low: int, high: int) -> Column:
    """Index of the first maximum between nodes low and high, both included."""
    part = F.slice(xs, low + 1, high - low + 1)
    return let(part, lambda p: F.array_position(p, F.array_max(p)) + (low - 1)).cast("int")


def warp(xs: Column, peak_at: Column, reference: Column, nodes: int) -> Column:
    """Curve on a piecewise linear time map that moves node peak_at to node reference."""
    source = lambda j: F.when(j <= reference, j * peak_at / reference).otherwise(
        peak_at + (j - reference) * (nodes - 1 - peak_at) / (nodes - 1 - reference)
    )
    return F.transform(F.sequence(F.lit(0), F.lit(nodes - 1)), lambda j: at_position(xs, source(j.cast("double"))))


def median(xs: Column) -> Column:
    s = F.array_sort(xs)
    n = F.size(xs)
    half = F.floor(n / 2).cast("int")
    return let(s, lambda v: F.when(n % 2 == 1, F.get(v, half)).otherwise((F.get(v, half - 1) + F.get(v, half)) / 2))


def quantile(xs: Column, p: float) -> Column:
    """Linearly interpolated quantile of the values of an array."""

    def between(v: Column) -> Column:
        at = p * (F.size(v) - 1)
        low = F.floor(at).cast("int")
        return F.get(v, low) + (at - low) * (F.coalesce(F.get(v, low + 1), F.get(v, low)) - F.get(v, low))

    return let(F.array_sort(xs), between)


def hampel_flags(xs: Column, radius: int = 5, z: float = 8.0, ratio: float = 4.0) -> Column:
    """Booleans: isolated high values against the neighbours within radius, the value itself left out."""

    def flag(x: Column, i: Column) -> Column:
        around = F.concat(F.slice(xs, F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius))), F.slice(xs, i + 2, F.lit(radius)))

        def test(near: Column) -> Column:
            high = let(
                median(near),
                lambda m: let(
                    median(F.transform(near, lambda v: F.abs(v - m))),
                    lambda mad: x > F.greatest(m + z * F.greatest(1.4826 * mad, F.lit(EPSILON)), ratio * F.greatest(m, F.lit(EPSILON))),
                ),
            )
            return F.when(F.size(near) >= 4, high).otherwise(False)

        return let(around, test)

    return F.transform(xs, flag)


def repair(xs: Column, flags: Column) -> Column:
    """Flagged values interpolated from the nearest unflagged ones, held at the edges; null below two good values."""
    def with_flags(f: Column) -> Column:
        good = F.filter(F.transform(f, lambda x, i: F.when(~x, i)), lambda i: i.isNotNull())

        def fill(g: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                before, after = F.array_max(F.filter(g, lambda k: k < i)), F.array_min(F.filter(g, lambda k: k > i))
                inside = F.get(xs, before) + (F.get(xs, after) - F.get(xs, before)) * (i - before) / (after - before)
                return F.when(~F.get(f, i), x).when(before.isNull(), F.get(xs, after)).when(after.isNull(), F.get(xs, before)).otherwise(inside)

            return F.when(F.size(g) >= 2, F.transform(xs, one))

        return let(good, fill)

    return let(flags, with_flags)


def serialise_flags(flags: Column) -> tuple[Column, Column]:
    """Semicolon lists of flagged steps (from 0) and of their time in percent (6 decimals)."""
    steps = F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    last = F.greatest(F.size(flags) - 1, F.lit(1))
    return F.array_join(steps.cast("array<string>"), ";"), F.array_join(F.transform(steps, lambda i: F.format_string("%.6f", 100.0 * i / last)), ";")


def doubled(xs: Column, rows: Column | int) -> Column:
    """Whether an array of 2 * rows values repeats its first half exactly."""
    n = F.lit(rows) if isinstance(rows, int) else rows
    return (F.size(xs) == 2 * n) & (F.slice(xs, F.lit(1), n) == F.slice(xs, n + 1, n))


def halved(xs: Column, rows: int) -> Column:
    return F.when(doubled(xs, rows), F.slice(xs, 1, rows)).otherwise(xs)


def observable(xs: Column, raw_length: Column, rows: int) -> Column:
    """Prefix of min(raw_length, rows) values."""
    return F.slice(xs, F.lit(1), F.least(raw_length, F.lit(rows)))


def tail_is_zero(xs: Column, raw_length: Column) -> Column:
    return F.forall(F.slice(xs, raw_length + 1, F.greatest(F.size(xs) - raw_length, F.lit(0))), lambda v: v == 0)


def digest(*arrays: Column) -> Column:
    """SHA-256 of curves' exact values, arrays kept apart."""
    return F.sha2(F.concat_ws("|", *[F.array_join(F.transform(a, lambda v: v.cast("string")), ",") for a in arrays]).cast("binary"), 256)
