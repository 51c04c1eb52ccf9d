"""Exact quantiles of groups of any size by narrowing brackets; no task ever holds a group's values.

``quantiles`` interpolates linearly between order statistics, as low * (1 - fraction) + high * fraction. It counts groups first.

Where every group has at most ``GATHERED`` values, equal values are counted and ranked in one
further pass. Larger ones take two further passes over the rows, both partially aggregated:

1. A mergeable sketch of each group gives, for each probability, a bracket whose ranks
   lie ``MARGIN / ACCURACY`` on either side of the one sought.
2. Values below a bracket are counted, those inside it are counted by value; the others are dropped
   before the shuffle. A bracket holds about 4 / ACCURACY of its group, however the values are distributed.

The sketch is not trusted: counts must show that a bracket holds its order statistics, else all
are made wider. Brackets that still hold over ``GATHERED`` different values are cut into
``BINS`` bins of equal depth, of which only those that hold the ranks stay, until they fit.
These rounds read what the second pass kept. So the last ranking, a window, has at most
GATHERED rows for a group and probability.

Nulls are left out, NaN stands above all other values; a group without values doesn't occur.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvestat.operators.lineage import cut, few

ACCURACY = 10_000
MARGIN = 2.0
GATHERED = 100_000
BINS = 128


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(and_, [left[k].eqNullSafe(right[f"{k}_"]) for k in keys])


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}_" for k in keys})


def _inside(rows: DataFrame, keys: list[str], sizes: DataFrame, probabilities: list[float], margin: float) -> DataFrame:
    """keys, t (place of the probability), v and c: how many values of the group equal v; v is null for those below t's bracket."""
    limits = sorted({min(1.0, max(0.0, p + side * margin / ACCURACY)) for p in probabilities for side in (-1, 1)})
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in limits]), F.lit(ACCURACY)).alias("s"), F.min("v").alias("least"), F.max("v").alias("most"))

    def at(p: float):
        return F.col("least") if p <= 0 else F.col("most") if p >= 1 else F.get("s", F.lit(limits.index(p)))

    brackets = [F.struct(at(min(1.0, max(0.0, p - margin / ACCURACY))).alias("lo"), at(min(1.0, max(0.0, p + margin / ACCURACY))).alias("hi")) for p in probabilities]
    known = few(cut(_renamed(sketch.select(*keys, F.array(*brackets).alias("brackets")), keys)))
    joined = rows.join(known, _same(rows, known, keys))
    # a value is of use to the probabilities whose bracket isn't below it
    place = F.transform("brackets", lambda b, i: F.when(F.col("v") <= b["hi"], F.struct(i.alias("t"), F.when(F.col("v") >= b["lo"], F.col("v")).alias("v"))))
    used = joined.select(*keys, F.explode(F.filter(place, lambda x: x.isNotNull())).alias("x"))
    return cut(used.groupBy(*keys, F.col("x.t").alias("t"), F.col("x.v").alias("v")).agg(F.count("*").alias("c")))


def _counted(rows: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """The same table with brackets that hold all values."""
    every = F.explode(F.sequence(F.lit(0), F.lit(len(probabilities) - 1)))
    return rows.groupBy(*keys, "v").agg(F.count("*").alias("c")).select(*keys, every.alias("t"), "v", "c")


def _targets(sizes: DataFrame, probabilities: list[float]) -> DataFrame:
    """Ranks low and high (from 0) and the fraction between them, of each group and probability."""
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    at = sizes.select("*", F.posexplode(ps).alias("t", "p")).withColumn("at", F.col("p") * (F.col("n") - 1))
    low = F.floor("at")
    return at.select(*[c for c in sizes.columns if c != "n"], "t", low.alias("low"), F.ceil("at").alias("high"), (F.col("at") - low).alias("fraction"))


def _narrowed(inside: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """inside with the bins only that hold the ranks; what lies in bins before them is counted with v null."""
    by = [*keys, "t"]
    edges = inside.filter("v IS NOT NULL").groupBy(*by).agg(F.percentile_approx("v", F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), F.lit(10 * BINS)).alias("edges"))
    edges = few(cut(_renamed(edges, by)))
    binned = inside.join(edges, _same(inside, edges, by)).withColumn("bin", F.when(F.col("v").isNull(), -1).otherwise(F.size(F.filter("edges", lambda e: e < F.col("v"))))).drop("edges", *[f"{k}_" for k in by])
    binned = cut(binned)
    upto = F.sum("held").over(Window.partitionBy(*by).orderBy("bin"))
    bins = binned.groupBy(*by, "bin").agg(F.sum("c").alias("held")).withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("held"))
    goals = _renamed(targets, by)
    bins = bins.join(goals, _same(bins, goals, by))
    # bins before the lower rank's are below, those between the ranks stay
    kept = bins.select(*[F.col(k).alias(f"{k}_") for k in [*by, "bin"]], (F.col("upto") <= F.col("low")).alias("is_below"), (F.col("before") <= F.col("high")).alias("is_used"))
    kept = few(cut(kept.filter("is_below OR is_used")))
    out = binned.join(kept, _same(binned, kept, [*by, "bin"]))
    value = F.when(~F.col("is_below"), F.col("v"))
    return cut(out.groupBy(*by, value.alias("v")).agg(F.sum("c").alias("c")))


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], gathered: int = GATHERED) -> DataFrame:
    """keys and q: the quantiles of value in each group, in the order of probabilities."""
    if not probabilities or not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    own = [f"k{i}" for i in range(len(keys))] or ["k0"]
    named = [F.col(k).alias(a) for k, a in zip(keys, own, strict=True)] if keys else [F.lit(0).alias("k0")]
    rows = df.select(*named, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    sizes = cut(rows.groupBy(*own).agg(F.count("*").alias("n")))
    targets = _targets(sizes, probabilities)
    if sizes.filter(F.col("n") > gathered).isEmpty():
        inside = _counted(rows, own, probabilities)
    else:
        inside = _bracketed(rows, own, sizes, targets, probabilities)
        while not inside.groupBy(*own, "t").count().filter(F.col("count") > gathered + 1).isEmpty():
            inside = _narrowed(inside, own, targets)
    by = [*own, "t"]
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_first()))
    ranked = inside.withColumn("upto", upto)
    goals = _renamed(targets, by)
    found = ranked.join(goals, _same(ranked, goals, by))
    pick = lambda rank: F.min(F.when((F.col("upto") > F.col(rank)) & F.col("v").isNotNull(), F.col("v")))
    both = found.groupBy(*by).agg(pick("low").alias("a"), pick("high").alias("b"), F.max("fraction").alias("fraction"))
    between = F.when(F.col("fraction") == 0, F.col("a")).otherwise(F.col("a") * (1 - F.col("fraction")) + F.col("b") * F.col("fraction"))
    q = both.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("t", between.alias("q")))).alias("q"))
    return q.select(*[F.col(a).alias(k) for a, k in zip(own, keys, strict=bool(keys))], F.col("q.q").alias("q"))


def _bracketed(rows: DataFrame, keys: list[str], sizes: DataFrame, targets: DataFrame, probabilities: list[float]) -> DataFrame:
    margin = MARGIN
    while True:
        inside = _inside(rows, keys, sizes, probabilities, margin)
        held = inside.groupBy(*keys, "t").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"), F.sum("c").alias("upto"))
        goals = _renamed(targets, [*keys, "t"])
        bad = goals.join(held, _same(held, goals, [*keys, "t"]), "left").filter("below IS NULL OR below > low OR upto <= high")
        if bad.isEmpty():
            return inside
        margin *= 8
