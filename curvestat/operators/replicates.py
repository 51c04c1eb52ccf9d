"""Metrics of each replicate from its component arrays, and the two-way bootstrap of scalar shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvestat.functions import reliability as R
from curvestat.functions.arrays import weights
from curvestat.operators.components import DESIGN_ACTIONS, integrate_with_arrays
from curvestat.operators.resampling import QUANTILES, spread

#: Replicates whose thresholds are sought at once.
TOGETHER = 2048


def reliability_curves(b: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Reliability at each node of each replicate (rows) for its number of trials n; 0 where its denominator isn't positive."""
    total = b + w / n[:, None]
    return np.divide(b, total, out=np.zeros_like(b), where=total > 0)


def pointwise_thresholds(b: np.ndarray, w: np.ndarray, weight: np.ndarray, target: float, most: int = R.MOST_TRIALS) -> np.ndarray:
    """Smallest n up to ``most`` of each replicate (row) whose phase-mean reliability reaches the target, infinity if none does.

    Reliability rises with n, so the range of all replicates is halved together.
    """
    low, high = np.ones(len(b), dtype=np.int64), np.full(len(b), most, dtype=np.int64)
    reaches = lambda n: reliability_curves(b, w, n.astype(float)) @ weight >= target
    attainable = ((b > 0) @ weight + 1e-14 >= target) & reaches(high)
    while (low < high).any():
        middle = (low + high) >> 1
        enough = reaches(middle)
        low, high = np.where(enough | (low >= high), low, middle + 1), np.where(enough, middle, high)
    return np.where(attainable, low.astype(float), np.inf)


def metric_names(grid=R.GRID, targets=R.TARGETS) -> list[str]:
    per_n = [name for n in grid for name in (f"R_L2_m{n}", f"mean_pointwise_reliability_m{n}")]
    return per_n + [name for t in targets for name in (f"required_n_R_L2_{round(100 * t)}", f"required_n_mean_pointwise_R_{round(100 * t)}")]


def metric_table(components: DataFrame, keys: list[str], nodes: int, grid=R.GRID, targets=R.TARGETS, most: int = R.MOST_TRIALS) -> DataFrame:
    """B, W, boundary, both reliabilities over the grid and both thresholds at the targets, one row for each combination of keys.

    components: keys, node, sigma2_b, sigma2_w, interior. One aggregate brings a replicate's nodes together; the pointwise
    reliabilities and thresholds of a batch of replicates are matrix products.
    """
    table = integrate_with_arrays(components, keys, nodes)
    b, w = F.col("B"), F.col("W")
    trace = {f"R_L2_m{n}": R.reliability(b, w, F.lit(float(n))) for n in grid} | {f"required_n_R_L2_{round(100 * t)}": R.required_trials(b, w, t) for t in targets}
    table = table.select(*keys, "B", "W", "boundary_nodes", "boundary_fraction", *[v.alias(k) for k, v in trace.items()], "bs", "ws")
    weight, kept = np.asarray(weights(nodes)), [c for c in table.columns if c not in ("bs", "ws")]
    pointwise = [f"mean_pointwise_reliability_m{n}" for n in grid] + [f"required_n_mean_pointwise_R_{round(100 * t)}" for t in targets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                bs, ws = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, nodes) for c in ("bs", "ws"))
                made = [reliability_curves(bs, ws, np.full(len(bs), float(n))) @ weight for n in grid] + [pointwise_thresholds(bs, ws, weight, t, most) for t in targets]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, made)], names=[*kept, *pointwise])

    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in kept)
    out = table.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} double" for c in pointwise))
    return out.select(*keys, "B", "W", "boundary_nodes", "boundary_fraction", *metric_names(grid, targets))


def two_way_replicates(cells: DataFrame, counts_of, keys: list[str], stream: str) -> DataFrame:
    """Two-way components (action, athlete, action_athlete, residual) of each replicate and combination of keys.

    cells: keys, athlete, action, r, mean, ss of a balanced design. Drawn copies of an athlete are athletes of their
    own. counts_of(stream's value, number of athletes): the matrix replicates x athletes of how often each is drawn, so that
    families of different streams aren't paired. A replicate's sums of squares are products of that matrix with the athletes'
    cell means, one row of keys at a time; draws are never joined to cells.
    """
    per = cells.groupBy(*keys, "athlete").agg(F.sort_array(F.collect_list(F.struct("action", "mean"))).alias("x"), F.sum("ss").alias("ss"), F.min("r").alias("r"))
    gathered = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("athlete", F.col("x.mean").alias("mean"), "ss"))).alias("g"), F.min("r").alias("r"))
    source = spread(gathered.select(*keys, F.col("g.mean").alias("mean"), F.col("g.ss").alias("ss"), "r"), *keys)
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keys)
    parts = ("action", "athlete", "action_athlete", "residual")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                mean, within, r = np.stack(row["mean"]), np.asarray(row["ss"]), float(row["r"])
                p, a = mean.shape
                if (row[stream], p) not in drawn:
                    drawn[row[stream], p] = counts_of(row[stream], p)
                counts = drawn[row[stream], p]
                mean = mean - mean.mean()  # so that nothing cancels
                athlete = mean.mean(axis=1)
                by_action = counts @ mean / p
                grand = by_action.mean(axis=1)
                spread_action = ((by_action - grand[:, None]) ** 2).sum(axis=1)
                spread_athlete = np.maximum(counts @ athlete**2 - p * grand**2, 0)
                rest = counts @ ((mean - athlete[:, None]) ** 2).sum(axis=1) - p * spread_action
                ms_p, ms_a = a * r * spread_athlete / (p - 1), p * r * spread_action / (a - 1)
                ms_pa, ms_e = r * rest / ((p - 1) * (a - 1)), counts @ within / (p * a * (r - 1))
                values = ((ms_a - ms_pa) / (p * r), (ms_p - ms_pa) / (a * r), (ms_pa - ms_e) / r, ms_e)
                out = pd.DataFrame({"rep": np.arange(1, len(counts) + 1), **{f"sigma2_{k}": np.maximum(v, 0) for k, v in zip(parts, values, strict=True)}})
                for k in keys:
                    out.insert(0, k, row[k])
                yield out[[*keys, "rep", *[f"sigma2_{k}" for k in parts]]]

    return source.mapInPandas(run, f"{kinds}, rep int, " + ", ".join(f"sigma2_{k} double" for k in parts))


#: Trials of the context reliabilities of a replicate.
CELL_TRIALS, ACROSS_TRIALS = 10, 50


def share_table(components: DataFrame, keys: list[str], node_weight) -> DataFrame:
    """Shares of the integrated two-way components and the three context reliabilities of each replicate."""
    parts = ("action", "athlete", "action_athlete", "residual")
    sums = components.groupBy(*keys, "rep").agg(*[F.sum(F.col(f"sigma2_{k}") * node_weight).alias(k) for k in parts])
    a, p, pa_, e = (F.col(k) for k in parts)
    return sums.select(
        *keys, "rep", *[R.safe_ratio(F.col(k), a + p + pa_ + e).alias(f"omega_{k}") for k in parts],
        R.safe_ratio(a + p + pa_, a + p + pa_ + e / CELL_TRIALS).alias(f"all_cells_n{CELL_TRIALS}"),
        R.safe_ratio(p + pa_, p + pa_ + e / CELL_TRIALS).alias(f"pooled_fixed_actions_n{CELL_TRIALS}"),
        F.when(p > 0, p / (p + pa_ / DESIGN_ACTIONS + e / (DESIGN_ACTIONS * ACROSS_TRIALS))).otherwise(F.lit(0.0)).alias(f"athlete_across_actions_n{ACROSS_TRIALS}"),
    )


def limits(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """2.5, 50 and 97.5 % of each metric over the replicates, long."""
    q = F.percentile("value", F.array(*[F.lit(x) for x in QUANTILES]))
    long = table.unpivot(keys, metrics, "metric", "value").groupBy(*keys, "metric").agg(F.count("*").alias("replicates"), q.alias("q"))
    return long.select(*keys, "metric", "replicates", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p025", "p500", "p975"))])
