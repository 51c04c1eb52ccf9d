"""Normal distribution functions (vectorised Python) and kernel density (built-in)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    from statistics import NormalDist

    return x.map(NormalDist().cdf, na_action="ignore")


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    from statistics import NormalDist

    return p.map(NormalDist().inv_cdf, na_action="ignore")


def kde_at(x: Column, at: Column, bandwidth: Column) -> Column:
    """Aggregate: Gaussian kernel density of x at a point."""
    return F.avg(F.exp(-0.5 * F.pow((at - x) / bandwidth, F.lit(2.0)))) / (F.max(bandwidth) * math.sqrt(2 * math.pi))


def quantile_error(draws: DataFrame, keys: list[str], x: str, p: float) -> DataFrame:
    """Monte-Carlo standard error of the p quantile of x: sqrt(p(1-p)/n) over the density there (Scott's bandwidth)."""
    stats = draws.groupBy(*keys).agg(F.percentile(x, F.lit(p)).alias("q"), F.stddev_samp(x).alias("sd"), F.count(x).cast("double").alias("n"))
    stats = stats.withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
    joined = draws.join(stats, keys)
    return joined.groupBy(*keys).agg(F.max("q").alias("q"), F.max("n").alias("n"), kde_at(F.col(x), F.col("q"), F.col("h")).alias("density")).withColumn(
        "se", F.sqrt(F.lit(p * (1 - p)) / F.col("n")) / F.col("density")
    )
