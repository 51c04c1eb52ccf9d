"""Resampling: portable draws, cluster bootstrap from group statistics, balanced subsamples."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvestat.functions import reliability as R
from curvestat.functions.arrays import finite
from curvestat.operators.components import components_from_sums
from curvestat.operators.lineage import cut, few

INFINITY = float("inf")
QUANTILES = (0.025, 0.5, 0.975)


def hash_key(*parts: Column) -> Column:
    """First 32 bits of the MD5 of the parts joined by '|', as a long; any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_matrix(before: list[str], items: list) -> np.ndarray:
    """``hash_key`` of each text with each item behind it, texts x items."""
    from hashlib import md5

    ends = [str(x).encode() for x in items]
    raw = b"".join(md5(start + end).digest()[:4] for start in (x.encode() for x in before) for end in ends)
    return np.frombuffer(raw, dtype=">u4").reshape(len(before), len(ends))


#: Modulus and multiplier of ``mixed``: products of numbers below the modulus fit a signed long.
MODULUS, FACTOR, ROUNDS = 2147483647, 48271, 4


def mixed(*parts: Column) -> Column:
    """A number below 2^31 - 1 from whole numbers, in integer arithmetic that any SQL engine and NumPy can repeat."""
    m = F.lit(MODULUS)
    once = lambda x, _: F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * FACTOR + 1, m)
    # folds, as x stands twice in each round
    rounds = lambda h, part: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.pmod(h + F.pmod(part, m) + 1, m), once)
    return F.aggregate(F.array(*[p.cast("bigint") for p in parts]), F.lit(0).cast("bigint"), rounds)


def mixed_matrix(*parts: np.ndarray | int) -> np.ndarray:
    """``mixed`` of arrays of whole numbers that are broadcast against each other."""
    x = np.int64(0)
    for part in parts:
        x = (x + np.asarray(part, dtype=np.int64) % MODULUS + 1) % MODULUS
        for _ in range(ROUNDS):
            x = ((x ^ (x >> 15)) * FACTOR + 1) % MODULUS
    return x


def draws(spark: SparkSession, reps: int, groups: DataFrame, seed: int, name: str = "athlete") -> DataFrame:
    """rep, group and cnt of whole-group draws with replacement; shared by all keys of a design.

    groups: the distinct groups. Draw i of a replicate takes the group at rank
    hash(seed, rep, i) mod their number.
    """
    # the groups are a dimension: one row each in this window
    ranked = groups.select(name).distinct().withColumn("at", F.row_number().over(Window.orderBy(name)) - 1)
    size = ranked.agg(F.count("*").alias("k"))
    picks = spark.range(1, reps + 1).select(F.col("id").cast("int").alias("rep")).crossJoin(F.broadcast(size)).withColumn("draw", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    picks = picks.withColumn("at", F.pmod(hash_key(F.lit(seed), F.col("rep"), F.col("draw")), F.col("k")).cast("int"))
    return picks.join(ranked, "at").groupBy("rep", name).agg(F.count("*").alias("cnt"))


def bootstrap_components(cells: DataFrame, drawn: DataFrame, keys: list[str], group: str = "athlete") -> DataFrame:
    """Components of each replicate and combination of keys, from cell statistics (n, mean, ss).

    The draws are joined to group statistics, never to trials; sums are centred
    in a second aggregate of the same groups.
    """
    joined = cells.join(drawn, group)
    sums = joined.groupBy("rep", *keys).agg(
        F.sum("cnt").alias("p"),
        F.min("n").alias("m"),
        F.sum(F.col("cnt") * F.col("mean")).alias("s1"),
        F.sum(F.col("cnt") * F.col("mean") * F.col("mean")).alias("s2"),
        F.sum(F.col("cnt") * F.col("ss")).alias("ssw"),
    )
    ssb = F.col("m") * F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("p"), F.lit(0.0))
    return components_from_sums(sums.withColumn("ssb", ssb))


def bootstrap_two_way(cells: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    """Two-way components of each replicate, from cell statistics by athlete and action.

    Drawn copies of an athlete are athletes of their own, so sums are weighted by cnt.
    """
    joined = cells.join(drawn, "athlete")
    per_athlete = joined.groupBy("rep", *keys, "athlete").agg(F.max("cnt").alias("cnt"), F.count("*").alias("a"), F.min("r").alias("r"), F.avg("mean").alias("mean"), (F.var_pop("mean") * F.count("*")).alias("between"), F.sum("ss").alias("ss"))
    per_action = joined.groupBy("rep", *keys, "action").agg((F.sum(F.col("cnt") * F.col("mean")) / F.sum("cnt")).alias("mean"))
    c = F.col("cnt")
    one = per_athlete.groupBy("rep", *keys).agg(
        F.sum(c).alias("p"), F.min("a").alias("a"), F.min("r").alias("r"),
        (F.sum(c * F.col("mean") * F.col("mean")) - F.sum(c * F.col("mean")) * F.sum(c * F.col("mean")) / F.sum(c)).alias("s_athlete"),
        F.sum(c * F.col("between")).alias("s_rest"), F.sum(c * F.col("ss")).alias("ss_e"),
    )
    two = per_action.groupBy("rep", *keys).agg((F.var_pop("mean") * F.count("*")).alias("s_action"))
    both = one.join(two, ["rep", *keys])
    p, a, r = F.col("p"), F.col("a"), F.col("r")
    ms_p, ms_a = R.ieee_ratio(a * r * F.greatest(F.col("s_athlete"), F.lit(0.0)), p - 1), R.ieee_ratio(p * r * F.col("s_action"), a - 1)
    ms_pa, ms_e = R.ieee_ratio(r * (F.col("s_rest") - p * F.col("s_action")), (p - 1) * (a - 1)), R.ieee_ratio(F.col("ss_e"), p * a * (r - 1))
    zero = F.lit(0.0)
    return both.select(
        "rep", *keys,
        F.greatest((ms_a - ms_pa) / (p * r), zero).alias("sigma2_action"), F.greatest((ms_p - ms_pa) / (a * r), zero).alias("sigma2_athlete"),
        F.greatest((ms_pa - ms_e) / r, zero).alias("sigma2_action_athlete"), ms_e.alias("sigma2_residual"),
    )


def subsample(trials: DataFrame, reps: int, seed: int, cell: list[str], order: str, size: Column) -> DataFrame:
    """rep and trials of balanced subsamples without replacement: the ``size`` smallest hashes of each cell."""
    with_rep = trials.crossJoin(F.broadcast(trials.sparkSession.range(1, reps + 1).select(F.col("id").cast("int").alias("rep"))))
    keyed = with_rep.withColumn("h", hash_key(F.lit(seed), F.col("rep"), *[F.col(c) for c in cell], F.col(order)))
    place = F.row_number().over(Window.partitionBy("rep", *cell).orderBy("h", order))
    return keyed.withColumn("place", place).filter(F.col("place") <= size).drop("h", "place")


#: Curves that a task of the subsamples sums at once, and hashes that it makes at once.
CHUNK, HASHES = 4096, 1 << 19
#: Most blocks of replicates into which the choice of a cell's trials is dealt, each with the numbers of all of them.
PARTS = 16


def _joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of a table of one row for each combination of keys, a null key its own."""
    named = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    return rows.join(named, reduce(and_, [rows[k].eqNullSafe(named[f"_{k}"]) for k in keys])).drop(*[f"_{k}" for k in keys])


def _blocks(seed: int, key: tuple, reps: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of some replicates and ``hash_key`` of each with every trial, about HASHES at once."""
    name = "|".join(str(c) for c in key)
    for at in np.array_split(np.arange(len(reps)), -(-len(reps) * len(t) // HASHES)):
        if len(at):
            yield at, hash_matrix([f"{seed}|{rep}|{name}|" for rep in reps[at]], t.tolist())


def subsample_limits(trials: DataFrame, reps: int, seed: int, size: Column, order: str, cell: list[str]) -> DataFrame:
    """cell, size and, by replicate in order, hash and trial of the last trial that the cell's subsample takes (hs, ts).

    Looks at the numbers of trials alone, never at their curves.
    """
    sizes = trials.groupBy(*cell).agg(F.count("*").alias("n"), F.max(size).cast("int").alias("size")).filter("size > 0")
    plan = few(cut(sizes.withColumn("parts", F.least(F.lit(PARTS), F.lit(reps), F.ceil(F.col("n") * reps / (8 * HASHES))).cast("int"))))
    kinds = ", ".join(f"{c} {trials.schema[c].dataType.simpleString()}" for c in cell)
    ids = _joined(trials.select(*cell, F.col(order).cast("bigint").alias("t")), plan, cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, k, part, parts = np.sort(rows["t"].to_numpy()), min(int(rows["size"].iloc[0]), len(rows)), key[-1], int(rows["parts"].iloc[0])
        own = np.arange(reps * part // parts + 1, reps * (part + 1) // parts + 1)
        hs, at = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
        for some, h in _blocks(seed, key[:-1], own, t):
            at[some] = np.argsort(h, axis=1, kind="stable")[:, k - 1]
            hs[some] = h[np.arange(len(some)), at[some]]
        return pd.DataFrame({**{c: [v] for c, v in zip(cell, key, strict=False)}, "part": [part], "size": [k], "hs": [hs], "ts": [t[at]]})

    blocks = spread(ids, *cell, "part").groupBy(*cell, "part").applyInPandas(last, f"{kinds}, part int, size int, hs array<bigint>, ts array<bigint>")
    whole = blocks.groupBy(*cell).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("part", "hs", "ts"))).alias("x"))
    return whole.select(*cell, "size", F.flatten("x.hs").alias("hs"), F.flatten("x.ts").alias("ts"))


def subsample_cells(trials: DataFrame, reps: int, seed: int, size: Column, order: str = "trial", group: str = "athlete", also: tuple[str, ...] = ()) -> DataFrame:
    """rep, cell, node, n, mean and ss of the balanced subsamples of ``subsample``, by NumPy over chunks of each cell's curves y.

    A cell is a group, or a combination of group and the columns of ``also``; ``order`` is a whole number, unique in a cell. Trials are
    chosen by cell and number alone, so curves of several waveforms with the same numbers get the same choice.
    The last trial that each replicate takes is found from the numbers; then every chunk of about CHUNK curves knows which of its
    trials are taken, and its sums are added up. So no task holds a cell's curves, or more than its trials' numbers and about HASHES hashes.
    """
    cell = [group, *also]
    limits = cut(subsample_limits(trials, reps, seed, size, order, cell))
    curves = trials.select(*cell, F.col(order).cast("bigint").alias("t"), F.col("y").cast("array<double>").alias("y"))
    # sums are taken about the cell's mean curve, so that nothing cancels
    centres = curves.select(*cell, F.posexplode("y").alias("node", "v")).groupBy(*cell, "node").agg(F.avg("v").alias("v"))
    centres = centres.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("node", "v"))).alias("x")).select(*cell, F.col("x.v").alias("centre"))
    counts = few(cut(curves.groupBy(*cell).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))))
    dealt = _joined(curves, counts, cell).withColumn("chunk", F.pmod(F.xxhash64("t"), F.col("chunks")).cast("int")).drop("chunks")
    known = _joined(_joined(limits, centres, cell), counts, cell).withColumn("chunk", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))).drop("chunks")
    kinds = ", ".join(f"{c} {trials.schema[c].dataType.simpleString()}" for c in cell)

    def sums(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = {"rep": "int32", "node": "int32", "n": "int64", "s1": float, "s2": float, "centre": float}
        if rows.empty or known.empty:
            return pd.DataFrame({**{c: [] for c in cell}, **{c: np.zeros(0, kind) for c, kind in columns.items()}})
        t, centre = rows["t"].to_numpy(), np.asarray(known["centre"].iloc[0])
        hs, ts = np.asarray(known["hs"].iloc[0])[:, None], np.asarray(known["ts"].iloc[0])[:, None]
        y, q = np.stack(rows["y"]) - centre, len(centre)
        squares = y**2
        n, s1, s2 = np.zeros(reps, dtype=np.int64), np.zeros((reps, q)), np.zeros((reps, q))
        for some, h in _blocks(seed, key[:-1], np.arange(1, reps + 1), t):
            taken = ((h < hs[some]) | ((h == hs[some]) & (t[None, :] <= ts[some]))).astype(float)
            n[some], s1[some], s2[some] = taken.sum(1), taken @ y, taken @ squares
        out = {"rep": np.repeat(np.arange(1, reps + 1), q), "node": np.tile(np.arange(q), reps), "n": np.repeat(n, q), "s1": s1.ravel(), "s2": s2.ravel(), "centre": np.tile(centre, reps)}
        return pd.DataFrame({**{c: [v] * (reps * q) for c, v in zip(cell, key, strict=False)}, **out})

    by = [*cell, "chunk"]
    parts = spread(dealt, *by).groupBy(*by).cogroup(spread(known, *by).groupBy(*by)).applyInPandas(sums, f"{kinds}, rep int, node int, n bigint, s1 double, s2 double, centre double")
    total = parts.groupBy("rep", *cell, "node").agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.max("centre").alias("centre"))
    mean = F.col("s1") / F.col("n")
    return total.select("rep", *cell, "node", "n", (F.col("centre") + mean).alias("mean"), F.greatest(F.col("s2") - F.col("n") * mean * mean, F.lit(0.0)).alias("ss"))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Few rows of much work each, dealt over all cores; adaptive execution would bring small rows together."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys)


def percentile_summary(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long summary by metric over finite values: counts, mean, sd (0 for one value), quantiles, share of infinities."""
    long = table.unpivot(keys, metrics, "metric", "value")
    value = F.when(finite(F.col("value")), F.col("value"))
    quantile = F.percentile(value, F.array(*[F.lit(q) for q in QUANTILES]))
    out = long.groupBy(*keys, "metric").agg(F.count("*").alias("replicates"), F.count(value).alias("finite_replicates"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), quantile.alias("q"))
    none = F.col("finite_replicates") == 0
    get = lambda i: F.when(none, INFINITY).otherwise(F.get("q", F.lit(i)))
    return out.select(
        *keys, "metric", "replicates", "finite_replicates",
        F.when(none, INFINITY).otherwise(F.col("mean")).alias("mean"),
        F.when(none, INFINITY).otherwise(F.coalesce("sd", F.lit(0.0))).alias("sd"),
        get(0).alias("p025"), get(1).alias("p500"), get(2).alias("p975"),
        ((F.col("replicates") - F.col("finite_replicates")) / F.col("replicates")).alias("infinite_fraction"),
    )


def uniqueness(drawn: DataFrame, group: str = "athlete") -> DataFrame:
    """Distinct groups of each replicate, summarised."""
    per = drawn.groupBy("rep").agg(F.count_distinct(group).alias("distinct_groups"), F.max("cnt").alias("most"))
    q = F.percentile("distinct_groups", F.array(*[F.lit(x) for x in QUANTILES]))
    return per.agg(F.count("*").alias("replicates"), F.min("distinct_groups").alias("least"), F.max("distinct_groups").alias("greatest"), q.alias("q"), F.max("most").alias("most_copies")).select(
        "replicates", "least", "greatest", "most_copies", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p025", "p500", "p975"))]
    )


def block_quantiles(table: DataFrame, keys: list[str], value: str, order: str, blocks: int = 5, p: float = 0.975) -> DataFrame:
    """Smallest and largest p quantile over equal consecutive blocks of replicates."""
    w = Window.partitionBy(*keys).orderBy(order)
    per = table.withColumn("block", F.ntile(blocks).over(w)).groupBy(*keys, "block").agg(F.percentile(value, F.lit(p)).alias("q"))
    return per.groupBy(*keys).agg(F.min("q").alias("q_min"), F.max("q").alias("q_max"))


def contrasts(table: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Quantiles of right minus left over replicates, for each ordered pair of items, and whether they exclude 0."""
    left = table.select("rep", *keys, F.col(item).alias("left_item"), F.col(value).alias("left_value"))
    right = table.select("rep", *keys, F.col(item).alias("right_item"), F.col(value).alias("right_value"))
    both = left.join(right, ["rep", *keys]).filter(F.col("left_item") < F.col("right_item")).withColumn("d", F.col("right_value") - F.col("left_value"))
    q = both.filter(finite(F.col("d"))).groupBy(*keys, "left_item", "right_item").agg(F.percentile("d", F.array(*[F.lit(x) for x in QUANTILES])).alias("q"))
    get = lambda i: F.get("q", F.lit(i))
    return q.select(*keys, "left_item", "right_item", get(0).alias("p025"), get(1).alias("p500"), get(2).alias("p975"), ((get(0) > 0) | (get(2) < 0)).alias("excludes_zero"))


def basic_interval(point: Column, low: Column, high: Column) -> tuple[Column, Column]:
    return 2 * point - high, 2 * point - low


def bca(replicates: DataFrame, jackknife: DataFrame, point: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bias-corrected accelerated interval: acceleration from leave-one-out values, bias from the replicates."""
    from curvestat.functions.distributions import normal_cdf, normal_quantile

    centre = jackknife.groupBy(*keys).agg(F.avg(value).alias("centre"))
    d = F.col("centre") - F.col(value)
    acceleration = jackknife.join(centre, keys).groupBy(*keys).agg(R_safe(F.sum(d * d * d), 6 * F.pow(F.sum(d * d), F.lit(1.5))).alias("acceleration"))
    joined = replicates.join(point.select(*keys, F.col(value).alias("theta")), keys)
    below = joined.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(F.when(F.col(value) < F.col("theta"), 1.0).when(F.col(value) == F.col("theta"), 0.5).otherwise(0.0))).alias("less"), F.max("theta").alias("theta"), F.sort_array(F.collect_list(value)).alias("values"))
    share = F.greatest(0.5 / F.col("n"), F.least(1 - 0.5 / F.col("n"), F.col("less") / F.col("n")))
    z = below.withColumn("bias", normal_quantile(share)).join(acceleration, keys)
    tail = F.lit(1.959963984540054)
    adjusted = lambda sign: F.col("bias") + (F.col("bias") + sign * tail) / (1 - F.col("acceleration") * (F.col("bias") + sign * tail))
    out = z.withColumn("p_low", normal_cdf(adjusted(-1))).withColumn("p_high", normal_cdf(adjusted(1)))

    def quantile(p: Column) -> Column:
        at = p * (F.size("values") - 1)
        lo = F.floor(at).cast("int")
        return F.get("values", lo) + (at - lo) * (F.coalesce(F.get("values", lo + 1), F.get("values", lo)) - F.get("values", lo))

    return out.select(*keys, "theta", "bias", "acceleration", "p_low", "p_high", quantile(F.col("p_low")).alias("low"), quantile(F.col("p_high")).alias("high"))


def R_safe(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def drawn_counts(seed: int, reps: int, k: int) -> np.ndarray:
    """The draws of ``draws`` as a matrix of counts, replicates x groups in the order of their column."""
    at = hash_matrix([f"{seed}|{rep}|" for rep in range(1, reps + 1)], list(range(k))).ravel() % k
    return np.bincount(np.repeat(np.arange(reps) * k, k) + at.astype(np.int64), minlength=reps * k).reshape(reps, k).astype(float)


def blas_bootstrap(cells: DataFrame, counts_of, keys: list[str], group: str = "athlete") -> DataFrame:
    """B and W sums of squares of many replicates by one matrix product for each row of keys.

    counts_of: the matrix replicates x groups, in the order of the group column, from the number
    of groups; each task makes it for itself, so none is sent.
    """
    gathered = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(group, "n", "mean", "ss"))).alias("g"))
    source = gathered.select(*keys, F.col("g.n").cast("array<double>").alias("n"), F.col("g.mean").alias("mean"), F.col("g.ss").alias("ss"))
    kinds = ", ".join(f"{k} {source.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                mean, ss, m = np.asarray(row["mean"]), np.asarray(row["ss"]), float(min(row["n"]))
                if len(mean) not in made:
                    made[len(mean)] = counts_of(len(mean))
                counts = made[len(mean)]
                p = counts.sum(axis=1)
                centred = mean - mean.mean()
                ssb = m * np.maximum(counts @ centred**2 - (counts @ centred) ** 2 / p, 0)
                out = pd.DataFrame({"rep": np.arange(1, len(counts) + 1), "p": p.astype(np.int64), "m": int(m), "ssb": ssb, "ssw": counts @ ss})
                for k in keys:
                    out.insert(0, k, row[k])
                yield out[[*keys, "rep", "p", "m", "ssb", "ssw"]]

    return components_from_sums(source.mapInPandas(run, f"{kinds}, rep int, p bigint, m bigint, ssb double, ssw double"))
