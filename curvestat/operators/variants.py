"""Array variants: the body curves that the same estimators are fitted to, under several rules for joints and high values.

A variant is a set of joints and the fewest of them an interval needs; ``hampel`` takes the curve of
``HAMPEL_OF`` and repairs isolated high values in it before it is normalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvestat.functions import arrays
from curvestat.operators import components as C
from curvestat.operators import curve_audit, influence
from curvestat.schema import VARIANTS

HAMPEL_OF = "all14"
#: Names of the two quality rules and the variants they stand for.
RULES = {"unaltered_nonzero": "all14", "hampel_local_high_value": "hampel"}


def body_steps(joints: DataFrame, trial: list[str], variants: dict = VARIANTS) -> DataFrame:
    """Per trial and variant: xs, the mean displacement of the variant's valid joints on each interval, and the fewest of them.

    One aggregate gives the means of all variants, so frames are read and shuffled once whatever their number.
    """
    stepped = curve_audit.steps(joints, trial)
    held = {name: F.col("valid") & F.col("joint").isin(*chosen) for name, (chosen, _) in variants.items()}
    means = stepped.groupBy(*trial, "step").agg(*[F.struct(F.avg(F.when(ok, F.col("moved"))).alias("moved"), F.count_if(ok).alias("n")).alias(name) for name, ok in held.items()])
    gathered = means.groupBy(*trial).agg(F.sort_array(F.collect_list(F.struct("step", *held))).alias("s"))
    one = lambda name: F.struct(F.lit(name).alias("variant"), F.col(f"s.{name}.moved").alias("xs"), F.array_min(F.col(f"s.{name}.n")).alias("fewest"))
    return gathered.select(*trial, F.inline(F.array(*[one(name) for name in held])))


def short_of_joints(steps: DataFrame, variants: dict = VARIANTS) -> DataFrame:
    """Trials with an interval of fewer joints than their variant needs; must be empty before a fit."""
    return steps.filter(F.col("fewest") < _least(variants))


def _least(variants: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for name, (_, least) in variants.items() for x in (name, least)]), F.col("variant"))


def curves(steps: DataFrame, nodes: int, variants: dict = VARIANTS, radius: int = 5, z: float = 8.0, ratio: float = 4.0) -> DataFrame:
    """steps with y, the normalised curve, and flags (high values found), and the hampel variant beside the others.

    y is null where an interval has too few joints, where there are fewer than two intervals, and in the hampel variant
    where fewer than two values are left.
    """
    enough = steps.withColumn("xs", F.when(F.col("fewest") >= _least(variants), F.col("xs")))
    flagged = enough.filter(F.col("variant") == HAMPEL_OF).withColumn("flags", arrays.hampel_flags(F.col("xs"), radius, z, ratio))
    repaired = flagged.withColumn("xs", arrays.repair(F.col("xs"), F.col("flags"))).withColumn("variant", F.lit("hampel"))
    plain = enough.withColumn("flags", F.lit(None).cast("array<boolean>"))
    return plain.unionByName(repaired).withColumn("y", arrays.phase_normalise(F.col("xs"), nodes))


def cells(curved: DataFrame, group: str = "athlete", trial: str = "trial") -> DataFrame:
    """n, mean and sum of squares of each variant, node and group."""
    points = curved.select("variant", group, trial, F.posexplode("y").alias("node", "y"))
    return C.cell_statistics(points, ["variant", "node"], group)


def fits(of: DataFrame, nodes: int) -> DataFrame:
    """Component summary of each variant, from its cells."""
    return C.component_summary(C.one_way_from_cells(of, ["variant", "node"]), ["variant"], nodes)


def _by_rule(of: DataFrame, rules: dict[str, str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("name")) for rule, name in rules.items()])
    rule = F.filter(pairs, lambda x: x["name"] == F.col("variant"))
    return of.filter(F.col("variant").isin(*rules.values())).withColumn("quality_rule", F.get(rule, F.lit(0))["rule"])


def leave_one_out(of: DataFrame, nodes: int, group: str = "athlete", rules: dict[str, str] = RULES) -> DataFrame:
    """Summary of the fit without each group, under every quality rule."""
    left = influence.leave_one_out(_by_rule(of, rules), ["quality_rule", "node"], group)
    return C.component_summary(left, ["quality_rule", "excluded"], nodes)


def contributions(of: DataFrame, nodes: int, group: str = "athlete", rules: dict[str, str] = RULES) -> DataFrame:
    """Shares of each group in the within-group sum of squares and in the squared deviations of means, under every quality rule."""
    return influence.contributions(_by_rule(of, rules), ["quality_rule"], nodes, group)
