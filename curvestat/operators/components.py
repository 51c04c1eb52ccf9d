"""Variance components per phase node, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvestat.functions import reliability as R
from curvestat.functions.arrays import node_weight


def components_from_sums(df: DataFrame) -> DataFrame:
    """Adds msb, msw, interior, sigma2_b and sigma2_w to ssb, ssw, groups p and trials m.

    Where msb is below msw both sums of squares are pooled into the residual. With one group or one trial
    a mean square has no degrees of freedom and is not a number; not a number counts as above all numbers.
    """
    p, m = F.col("p"), F.col("m")
    df = df.withColumn("msb", R.ieee_ratio(F.col("ssb"), p - 1)).withColumn("msw", R.ieee_ratio(F.col("ssw"), p * (m - 1)))
    df = df.withColumn("interior", F.col("msb") >= F.col("msw"))
    return df.withColumn("sigma2_b", F.when(F.col("interior"), (F.col("msb") - F.col("msw")) / m).otherwise(0.0)).withColumn(
        "sigma2_w", F.when(F.col("interior"), F.col("msw")).otherwise(R.ieee_ratio(F.col("ssb") + F.col("ssw"), p * m - 1))
    )


def cell_statistics(nodes: DataFrame, keys: list[str], group: str = "athlete", value: str = "y") -> DataFrame:
    """n, mean and centred sum of squares of each group at each node; partially aggregated."""
    return nodes.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("ss"))


def one_way_from_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    out = cells.groupBy(*keys).agg(F.count("*").alias("p"), F.min("n").alias("m"), (F.min("n") * F.var_pop("mean") * F.count("*")).alias("ssb"), F.sum("ss").alias("ssw"))
    return components_from_sums(out)


def one_way(nodes: DataFrame, keys: list[str], group: str = "athlete", value: str = "y") -> DataFrame:
    """Balanced one-way constrained components for each combination of keys (node among them)."""
    return one_way_from_cells(cell_statistics(nodes, keys, group, value), keys)


def _integrals(nodes: int) -> list:
    w = node_weight(F.col("node"), nodes)
    return [F.sum(F.col("sigma2_b") * w).alias("B"), F.sum(F.col("sigma2_w") * w).alias("W"), F.count_if(~F.col("interior")).alias("boundary_nodes"), F.count("*").alias("nodes")]


def integrate(components: DataFrame, keys: list[str], nodes: int) -> DataFrame:
    """B, W and boundary_nodes over the phase for each combination of keys."""
    return components.groupBy(*keys).agg(*_integrals(nodes)).withColumn("boundary_fraction", F.col("boundary_nodes") / F.col("nodes"))


def _ordered():
    return F.sort_array(F.collect_list(F.struct("node", "sigma2_b", "sigma2_w"))).alias("x")


def integrate_with_arrays(components: DataFrame, keys: list[str], nodes: int) -> DataFrame:
    """As integrate, with components as arrays bs and ws in the same aggregate."""
    out = components.groupBy(*keys).agg(*_integrals(nodes), _ordered())
    return out.select(*keys, "B", "W", "boundary_nodes", (F.col("boundary_nodes") / F.col("nodes")).alias("boundary_fraction"), F.col("x.sigma2_b").alias("bs"), F.col("x.sigma2_w").alias("ws"))


def component_arrays(components: DataFrame, keys: list[str]) -> DataFrame:
    """bs and ws: components in node order as arrays, one row for each combination of keys."""
    return components.groupBy(*keys).agg(_ordered()).select(*keys, F.col("x.sigma2_b").alias("bs"), F.col("x.sigma2_w").alias("ws"))


def grid(spark, values, name: str = "n") -> DataFrame:
    """Small table of one column."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def component_summary(components: DataFrame, keys: list[str], nodes: int) -> DataFrame:
    """B, W, boundary, reliability and mean pointwise reliability over the grid, thresholds at both targets."""
    joined = integrate_with_arrays(components, keys, nodes)
    b, w = F.col("B"), F.col("W")
    columns = []
    for n in R.GRID:
        columns += [R.reliability(b, w, F.lit(float(n))).alias(f"R_L2_m{n}"), R.mean_pointwise(F.col("bs"), F.col("ws"), F.lit(float(n))).alias(f"mean_pointwise_reliability_m{n}")]
    for t in R.TARGETS:
        pct = round(100 * t)
        columns += [R.required_trials(b, w, t).alias(f"required_n_R_L2_{pct}"), R.required_pointwise(F.col("bs"), F.col("ws"), t).alias(f"required_n_mean_pointwise_R_{pct}")]
    return joined.select(*keys, "B", "W", "boundary_nodes", "boundary_fraction", *columns)


def design_study(components: DataFrame, keys: list[str], nodes: int) -> DataFrame:
    """Long form of both reliabilities over the grid of trial counts."""
    joined = integrate_with_arrays(components, keys, nodes).crossJoin(F.broadcast(grid(components.sparkSession, R.GRID, "trials_m")))
    n = F.col("trials_m").cast("double")
    return joined.select(*keys, "trials_m", R.reliability(F.col("B"), F.col("W"), n).alias("R_L2"), R.mean_pointwise(F.col("bs"), F.col("ws"), n).alias("mean_pointwise"))


PARTS = ("action", "athlete", "action_athlete", "residual")


def two_way(nodes: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """Balanced two-way random components (athlete p, action a, trials r) for each combination of keys.

    Columns raw_* and sigma2_* (truncated at zero) for action, athlete, their
    interaction and the residual. One pass over trials; the other levels come
    from cell means, without joins. A mean square without degrees of freedom (one
    trial in the smallest cell, one athlete, one action) is not a number, and so is what needs it.
    """
    cells = nodes.groupBy(*keys, "athlete", "action").agg(F.count(value).alias("r"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("ss"))
    athletes = cells.groupBy(*keys, "athlete").agg(F.count("*").alias("a"), F.min("r").alias("r"), F.avg("mean").alias("mean"), (F.var_pop("mean") * F.count("*")).alias("between"), F.sum("ss").alias("ss"))
    # between: spread of cell means around their athlete; summed it holds actions and interaction
    by_athlete = athletes.groupBy(*keys).agg(F.count("*").alias("p"), F.min("a").alias("a"), F.min("r").alias("r"), (F.var_pop("mean") * F.count("*")).alias("s_athlete"), F.sum("between").alias("s_rest"), F.sum("ss").alias("ss_e"))
    actions = cells.groupBy(*keys, "action").agg(F.avg("mean").alias("mean"))
    by_action = actions.groupBy(*keys).agg((F.var_pop("mean") * F.count("*")).alias("s_action"))
    both = by_athlete.join(by_action, keys) if keys else by_athlete.crossJoin(by_action)
    p, a, r = F.col("p"), F.col("a"), F.col("r")
    both = both.withColumn("ms_athlete", R.ieee_ratio(a * r * F.col("s_athlete"), p - 1)).withColumn("ms_action", R.ieee_ratio(p * r * F.col("s_action"), a - 1))
    both = both.withColumn("ms_inter", R.ieee_ratio(r * (F.col("s_rest") - p * F.col("s_action")), (p - 1) * (a - 1))).withColumn("ms_error", R.ieee_ratio(F.col("ss_e"), p * a * (r - 1)))
    raw = {
        "action": (F.col("ms_action") - F.col("ms_inter")) / (p * r),
        "athlete": (F.col("ms_athlete") - F.col("ms_inter")) / (a * r),
        "action_athlete": (F.col("ms_inter") - F.col("ms_error")) / r,
        "residual": F.col("ms_error"),
    }
    return both.select(*keys, "p", "a", "r", *[v.alias(f"raw_{k}") for k, v in raw.items()], *[F.greatest(v, F.lit(0.0)).alias(f"sigma2_{k}") for k, v in raw.items()])


def two_way_pointwise(components: DataFrame) -> DataFrame:
    """Adds each component's share of the node's total, 0 where the total is 0."""
    total = sum((F.col(f"sigma2_{k}") for k in PARTS[1:]), F.col("sigma2_action"))
    return components.select("*", *[R.safe_ratio(F.col(f"sigma2_{k}"), total).alias(f"omega_{k}") for k in PARTS])


#: Actions and trials of the design in the context reliabilities.
DESIGN_ACTIONS, DESIGN_TRIALS = 6, 50


def context_reliabilities(a, p, pa, e, n) -> dict:
    """Reliability of an athlete across actions, of all cells, and of cells with fixed pooled actions."""
    return {
        "athlete_across_actions": F.when(p > 0, p / (p + pa / DESIGN_ACTIONS + e / (DESIGN_ACTIONS * n))).otherwise(F.lit(0.0)),
        "all_cells": R.safe_ratio(a + p + pa, a + p + pa + e / n),
        "pooled_fixed_actions": R.safe_ratio(p + pa, p + pa + e / n),
    }


def global_summary(components: DataFrame, keys: list[str], nodes: int) -> DataFrame:
    """Integrated two-way components, their shares and context reliabilities at 50 trials."""
    w = node_weight(F.col("node"), nodes)
    sums = [F.sum(F.col(f"sigma2_{k}") * w).alias(f"I_{k}") for k in PARTS]
    out = components.groupBy(*keys).agg(*sums)
    total = sum((F.col(f"I_{k}") for k in PARTS[1:]), F.col("I_action"))
    out = out.select("*", *[R.safe_ratio(F.col(f"I_{k}"), total).alias(f"omega_{k}") for k in PARTS])
    values = context_reliabilities(F.col("I_action"), F.col("I_athlete"), F.col("I_action_athlete"), F.col("I_residual"), F.lit(float(DESIGN_TRIALS)))
    return out.select("*", *[v.alias(f"context_{k}_n50") for k, v in values.items()])


def global_design_study(summary: DataFrame) -> DataFrame:
    out = summary.crossJoin(F.broadcast(grid(summary.sparkSession, R.GRID, "trials_per_cell")))
    values = context_reliabilities(F.col("I_action"), F.col("I_athlete"), F.col("I_action_athlete"), F.col("I_residual"), F.col("trials_per_cell").cast("double"))
    return out.select("trials_per_cell", *[v.alias(k) for k, v in values.items()])
