"""Unbalanced one-way restricted maximum likelihood by a profile over lambda = between / within."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvestat.operators.lineage import MOST_BROADCAST, cut

LOW, HIGH, STEPS = -20.0, 20.0, 81
OPEN_LOW, OPEN_HIGH = -32.0, 32.0
UPPER_WARNING = 31.5
TINY = float(np.finfo(float).tiny)
#: Points of a pass after the first, and the width of theta's bracket that ends the search.
POINTS, TOLERANCE = 257, 5e-7
#: Groups that are evaluated at once.
ROWS = 2048


def sufficient(nodes: DataFrame, keys: list[str], group: str = "athlete", value: str = "y") -> DataFrame:
    """n, sum and sum of squares of each group; these merge associatively."""
    y = F.col(value)
    return nodes.groupBy(*keys, group).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("z"))


def too_small(stats: DataFrame, least: int = 2) -> DataFrame:
    """Groups with fewer trials than the fit needs; must be empty."""
    return stats.filter(F.col("n") < least)


def objective(stats: DataFrame, keys: list[str], lam: Column) -> DataFrame:
    """Restricted profile objective at lambda (a column of stats), in SQL aggregates."""
    den = 1 + F.col("n") * lam
    sums = stats.groupBy(*keys).agg(
        F.sum(F.col("n") / den).alias("a"),
        F.sum(F.col("s") / den).alias("b"),
        F.sum(F.col("z") - lam * F.col("s") * F.col("s") / den).alias("q0"),
        F.sum(F.log1p(F.col("n") * lam)).alias("logs"),
        (F.sum("n") - 1).alias("df"),
    )
    q = F.greatest(F.col("q0") - F.col("b") * F.col("b") / F.col("a"), F.lit(TINY))
    return sums.select(*keys, "df", q.alias("q"), (F.col("b") / F.col("a")).alias("gls_mean"), (F.col("df") * F.log(q / F.col("df")) + F.col("logs") + F.log("a")).alias("objective"))


def profile(lam: np.ndarray, n: np.ndarray, s: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Objective and Q at each lambda for one node's groups."""
    lam = np.atleast_1d(lam)[:, None]
    den = 1 + n * lam
    a, b = (n / den).sum(1), (s / den).sum(1)
    q = np.maximum((z - lam * s * s / den).sum(1) - b * b / a, TINY)
    df = n.sum() - 1
    return df * np.log(q / df) + np.log1p(n * lam).sum(1) + np.log(a), q


def _partial_sums(stats: DataFrame, keys: list[str], points: int) -> DataFrame:
    """keys, i and the sums a, b, q, logs, trials of each batch of groups at its node's ith lambda; the last one is lambda = 0.

    stats has the node's bracket (lo, hi of theta); lambda = exp(theta) on ``points`` points from lo to hi.
    """
    kinds = ", ".join(f"{k} {stats.schema[k].dataType.simpleString()}" for k in keys)
    steps = np.arange(points) / max(points - 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            node = table.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(node, kind="stable")
            node = node[order]
            n, s, z, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False).astype(float)[order] for c in ("n", "s", "z", "lo", "hi"))
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            sums = np.zeros((4, len(first), points + 1))
            for at in range(0, len(n), ROWS):
                own = slice(at, at + ROWS)
                lam = np.exp(lo[own, None] + (hi - lo)[own, None] * steps)
                lam = np.concatenate([lam, np.zeros((len(lam), 1))], axis=1)
                m, t = n[own, None], s[own, None]
                den = 1 + m * lam
                new = np.flatnonzero(np.r_[True, node[own][1:] != node[own][:-1]])
                for k, x in enumerate((m / den, t / den, z[own, None] - lam * t * t / den, np.log1p(m * lam))):
                    sums[k, node[own][new]] += np.add.reduceat(x, new, axis=0)
            # one row for each node of the batch, with its sums as arrays
            keyed = batch.select(keys).take(pa.array(order[first]))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * (points + 1)), pa.array(x.ravel())) for x in sums]
            yield pa.RecordBatch.from_arrays([*keyed.columns, *lists, pa.array(np.add.reduceat(n, first))], names=[*keys, "a", "b", "q", "logs", "trials"])

    lists = ", ".join(f"{c} array<double>" for c in ("a", "b", "q", "logs"))
    partial = stats.select(*keys, "n", "s", "z", "lo", "hi").mapInArrow(run, f"{kinds}, {lists}, trials double")
    each = partial.select(*keys, "trials", F.posexplode(F.arrays_zip("a", "b", "q", "logs")).alias("i", "x"))
    return each.groupBy(*keys, "i").agg(*[F.sum(f"x.{c}").alias(c) for c in ("a", "b", "q", "logs")], F.sum("trials").alias("trials"))


def _searched(stats: DataFrame, keys: list[str], brackets: DataFrame, points: int, nodes: int) -> DataFrame:
    """Best point of each node's bracket and the points beside it: keys, lo, hi, theta, f, q, df, and f0, q0 at lambda = 0. nodes: the brackets' counted number."""
    known = brackets.select(*[F.col(k).alias(f"{k}_") for k in keys], "lo", "hi")
    known = F.broadcast(known) if nodes <= MOST_BROADCAST else known
    same = reduce(and_, [stats[k].eqNullSafe(known[f"{k}_"]) for k in keys])
    sums = _partial_sums(stats.join(known, same), keys, points)
    df = F.col("trials") - 1
    q = F.greatest(F.col("q") - F.col("b") * F.col("b") / F.col("a"), F.lit(TINY))
    value = df * F.log(q / df) + F.col("logs") + F.log("a")
    at = sums.select(*keys, "i", df.alias("df"), q.alias("q"), value.alias("f"))
    point = F.struct("f", "i", "q")
    best = at.groupBy(*keys).agg(F.min(F.when(F.col("i") < points, point)).alias("best"), F.max(F.when(F.col("i") == points, point)).alias("zero"), F.max("df").alias("df"))
    both = best.join(known, reduce(and_, [best[k].eqNullSafe(known[f"{k}_"]) for k in keys])).withColumn("step", (F.col("hi") - F.col("lo")) / (points - 1))
    theta = F.col("lo") + F.col("step") * F.col("best.i")
    return both.select(
        *keys, (theta - F.col("step")).alias("low"), (theta + F.col("step")).alias("high"), F.col("best.i").alias("i"), theta.alias("theta"),
        F.col("best.f").alias("f"), F.col("best.q").alias("q"), "df", F.col("zero.f").alias("f0"), F.col("zero.q").alias("q0"), "lo", "hi",
    )


def unbalanced(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Fit of each combination of keys: sigma2_b, sigma2_w, lambda, interior, converged, upper_warning.

    A pass evaluates the profile at many lambdas for all nodes at once: batches of groups are
    summed where they lie, so a node's groups are never brought together and a node may have any number of
    them. The first pass takes STEPS points of theta = ln lambda; each further one takes POINTS points
    between the neighbours of the best, which makes the bracket 128 times narrower. Nodes whose bracket is
    within TOLERANCE, or whose objective isn't finite, are finished and leave the passes. The groups' statistics
    are kept in the checkpoint folder, so trials are read once.
    """
    stats = cut(stats.select(*keys, "n", "s", "z"))
    first = cut(stats.select(*keys).distinct().select(*keys, F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")))
    state, done = cut(_searched(stats, keys, first, STEPS, first.count())), None
    state = state.withColumn("low", F.when(F.col("i") == 0, OPEN_LOW).otherwise(F.col("low"))).withColumn("high", F.when(F.col("i") == STEPS - 1, OPEN_HIGH).otherwise(F.col("high")))
    while True:
        is_open = (F.col("high") - F.col("low") > TOLERANCE) & (F.abs("f") < float("inf")) & ~F.isnan("f")
        finished, left = state.filter(~F.coalesce(is_open, F.lit(False))), state.filter(is_open)
        done = finished if done is None else done.unionByName(finished)
        nodes = left.count()
        if not nodes:
            break
        # a bracket's ends stay its own
        state = cut(_searched(stats, keys, left.select(*keys, F.col("low").alias("lo"), F.col("high").alias("hi")), POINTS, nodes))
        state = state.withColumn("low", F.greatest("low", "lo")).withColumn("high", F.least("high", "hi"))
    converged = (F.abs("f") < float("inf")) & ~F.isnan("f")
    fits = done.withColumn("converged", F.coalesce(converged, F.lit(False)))
    interior = F.col("converged") & (F.col("f0") > F.col("f") + 1e-11 * (1 + F.abs("f")))
    within = F.when(F.col("interior"), F.col("q")).otherwise(F.col("q0")) / F.col("df")
    fits = fits.withColumn("interior", interior).withColumn("sigma2_w", within).withColumn("lam", F.when(F.col("interior"), F.exp("theta")).otherwise(0.0))
    return fits.select(*keys, (F.col("lam") * F.col("sigma2_w")).alias("sigma2_b"), "sigma2_w", "lam", "interior", "converged", (F.col("theta") > UPPER_WARNING).alias("upper_warning"))
