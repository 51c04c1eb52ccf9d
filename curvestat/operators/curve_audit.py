"""Joint frames: displacement curves, missing joints, runs, jumps and per-trial quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvestat.functions.arrays import norm

JUMPS = (25.0, 50.0, 100.0, 200.0, 500.0)


def to_joints(frames: DataFrame, keys: list[str], coords: str, joints: int, selected: tuple[int, ...] | None = None) -> DataFrame:
    """Rows (keys, joint from 1, x, y, z) from flat coordinates; selected: joints to keep."""
    for j in selected or ():
        if not 1 <= j <= joints:
            raise ValueError(f"joint {j} is outside 1 to {joints}")
    wanted = F.array(*[F.lit(j) for j in selected or range(1, joints + 1)])
    at = lambda k: F.get(coords, (F.col("joint") - 1) * 3 + k).cast("double")
    return frames.select(*keys, coords, F.explode(wanted).alias("joint")).select(*keys, "joint", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def is_zero() -> Column:
    return (F.col("x") == 0) & (F.col("y") == 0) & (F.col("z") == 0)


def steps(joints: DataFrame, trial: list[str], frame: str = "frame") -> DataFrame:
    """Displacement of each joint on each interval, and whether both its ends hold the joint.

    Partitioned by trial and joint: a trial's joints move independently.
    """
    w = Window.partitionBy(*trial, "joint").orderBy(frame)
    before = lambda c: F.lag(c).over(w)
    zero = is_zero()
    out = joints.withColumn("zero", zero)
    moved = norm([F.col(c) - before(c) for c in ("x", "y", "z")])
    out = out.select(*trial, "joint", (F.col(frame) - 1).alias("step"), moved.alias("moved"), (~(F.col("zero") | before(F.col("zero")))).alias("valid"))
    return out.filter(F.col("moved").isNotNull())


def naive_body_curve(stepped: DataFrame, trial: list[str]) -> DataFrame:
    """Mean displacement over all joints."""
    return stepped.groupBy(*trial, "step").agg(F.avg("moved").alias("moved"))


def structural_body_curve(stepped: DataFrame, trial: list[str]) -> DataFrame:
    """Mean displacement over valid joints, and their number."""
    return stepped.groupBy(*trial, "step").agg(F.avg(F.when(F.col("valid"), F.col("moved"))).alias("moved"), F.count_if("valid").alias("valid_joints"))


def both_body_curves(stepped: DataFrame, trial: list[str]) -> DataFrame:
    """Either mean displacement and the number of valid joints, in one aggregate."""
    valid = F.when(F.col("valid"), F.col("moved"))
    return stepped.groupBy(*trial, "step").agg(F.avg("moved").alias("naive"), F.avg(valid).alias("structural"), F.count_if("valid").alias("valid_joints"))


def too_few_joints(curve: DataFrame, least: int) -> DataFrame:
    """Intervals below the fewest usable joints; must be empty."""
    return curve.filter(F.col("valid_joints") < least)


def zero_runs(joints: DataFrame, trial: list[str], frame: str = "frame") -> DataFrame:
    """Maximal runs of zero triplets of each joint, ends included, and whether they touch the trial's ends."""
    w = Window.partitionBy(*trial, "joint")
    marked = joints.select(*trial, "joint", frame, is_zero().alias("zero"), F.min(frame).over(w).alias("lo"), F.max(frame).over(w).alias("hi")).filter("zero")
    island = F.col(frame) - F.row_number().over(w.orderBy(frame))
    runs = marked.withColumn("island", island).groupBy(*trial, "joint", "island").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("run_length"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    return runs.select(*trial, "joint", "first", "last", "run_length", (F.col("first") == F.col("lo")).alias("touches_start"), (F.col("last") == F.col("hi")).alias("touches_end"))


def jump_counts(stepped: DataFrame, keys: list[str], thresholds: tuple[float, ...] = JUMPS) -> DataFrame:
    """Valid steps above each threshold, one column each."""
    return stepped.groupBy(*keys).agg(*[F.count_if(F.col("valid") & (F.col("moved") > t)).alias(f"above_{str(t).replace('.', '_')}") for t in thresholds])


def largest_jump(stepped: DataFrame, trial: list[str]) -> DataFrame:
    """Largest valid jump of each trial and its first place, by step and then joint."""
    order = F.struct("moved", (-F.col("step")).alias("s"), (-F.col("joint")).alias("j"))
    return stepped.filter("valid").groupBy(*trial).agg(F.max(order).alias("o")).select(*trial, F.col("o.moved").alias("jump"), (-F.col("o.s")).alias("step"), (-F.col("o.j")).alias("joint"))


def trial_quality(joints: DataFrame, stepped: DataFrame, trial: list[str]) -> DataFrame:
    """Zero triplets, joints affected, fewest valid joints, steps below 14, 13 and 10, largest and p99 valid jump."""
    zero = joints.groupBy(*trial).agg(F.count_if(is_zero()).alias("zero_triplets"), F.count_distinct(F.when(is_zero(), F.col("joint"))).alias("joints_affected"))
    per_step = stepped.groupBy(*trial, "step").agg(F.count_if("valid").alias("v"))
    fewest = per_step.groupBy(*trial).agg(F.min("v").alias("min_valid"), *[F.count_if(F.col("v") < k).alias(f"steps_below_{k}") for k in (14, 13, 10)])
    jumps = stepped.groupBy(*trial).agg(F.max(F.when(F.col("valid"), F.col("moved"))).alias("max_jump"), F.percentile(F.when(F.col("valid"), F.col("moved")), F.lit(0.99)).alias("p99_jump"))
    return zero.join(fewest, trial, "left").join(jumps, trial, "left")
