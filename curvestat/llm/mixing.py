"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code-point order, null last, weigh ``WEIGHTS`` in turn and
share ``SHARE`` of all words; a source's target stops at ``MOST`` times its
size, and the excess goes to the others by weight until none is above. That
fixed point is ``min(MOST * size, level * weight)``, with one level for all.

Copies: a document of a source at ratio r = target / size is taken floor(r)
times, and once more with probability r - floor(r). These fractions are rounded
dependently: two documents of a source meet, and mass, measured in words, moves
from one to the other until one fraction is 0 or 1; the direction is drawn so
that every expectation stays as it was. The other document goes on with what is
left. The words taken from a source therefore never differ from its target by
more than one document's size.

The meetings form a reduction tree: documents are dealt by hash over blocks of
about ``BLOCK`` documents of one source, a block is folded in one row by array
functions, large documents first so that small ones settle what is left, and the blocks' residual documents are the next level's documents.
A source with a third of all rows has a third of all blocks. Repeated rows are counted first and meet others as one
document: m rows at ratio r are given floor(m * r) copies together and the fraction that is
left takes part in the meetings, so no block grows with them. Draws are hashes
of the seed and both documents, so reruns agree.

Defined results: a null text has size 0, and takes 0 words; a source whose
documents are all empty has target 0; repeated rows (equal doc_id, source and text) count
each and share their copies evenly, to within one; an empty table gives an empty result; other columns of the
input are ignored. The table of sources is a dimension: one row per source, ranked by one
window over these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvestat.llm.common import cut, fresh, let, repeated, words

#: Weights of the sources in turn, share of all words, most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
#: Sources up to which their table is broadcast; beyond it the joins shuffle.
MOST_BROADCAST = 10_000
SEED = 8


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of each source; sizes: source, size, rows."""
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int")))
    weighed = weighed.withColumn("cap", MOST * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    # sources fill up in the order of cap / weight; the level is that of the first source that doesn't
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weighed = weighed.withColumn("level", left / F.sum("weight").over(after))
    open_level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything)
    return weighed.select("source", "source_size", F.least("cap", F.coalesce(open_level * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _meet(acc: Column, x: Column, level: int) -> Column:
    """One meeting of the residual acc.cur with document x: the integral one goes to acc.out."""
    size = lambda d: d["size"].cast("double")
    a = acc["cur"]
    masses = F.struct(
        F.least((1 - a["part"]) * size(a), x["part"] * size(x)).alias("to_a"),
        F.least(a["part"] * size(a), (1 - x["part"]) * size(x)).alias("to_x"),
    )

    def moved(m: Column) -> Column:
        up = _uniform(F.lit(SEED), F.lit(level), a["doc_id"], a["tie"], x["doc_id"], x["tie"]) * (m["to_a"] + m["to_x"]) < m["to_x"]
        # towards a: a is full (1) or x is empty (0); towards x: a is empty or x is full
        a_done = F.when(up, (1 - a["part"]) * size(a) <= x["part"] * size(x)).otherwise(a["part"] * size(a) <= (1 - x["part"]) * size(x))
        a_part = F.when(up, a["part"] + m["to_a"] / size(a)).otherwise(a["part"] - m["to_x"] / size(a))
        x_part = F.when(up, x["part"] - m["to_a"] / size(x)).otherwise(x["part"] + m["to_x"] / size(x))
        done = F.when(a_done, a.withField("part", F.when(up, 1.0).otherwise(0.0))).otherwise(x.withField("part", F.when(up, 0.0).otherwise(1.0)))
        rest = F.when(a_done, x.withField("part", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x_part)))).otherwise(
            a.withField("part", F.greatest(F.lit(0.0), F.least(F.lit(1.0), a_part)))
        )
        return F.struct(rest.alias("cur"), F.concat(acc["out"], F.array(done)).alias("out"))

    return let(masses, moved)


def _dimension(rows: DataFrame, few: bool) -> DataFrame:
    """A table of one row per source, broadcast only where the sources were counted and are few."""
    return F.broadcast(rows) if few else rows


def _level(open_docs: DataFrame, level: int, block: int, few: bool) -> DataFrame:
    """Fold each block: rows (cur, out) of the residual document and the decided ones."""
    fields = ["doc_id", "tie", "source", "size", "rows", "whole", "part", "source_size", "target"]
    blocks = open_docs.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks")).select(F.col("source").alias("b_source"), "blocks")
    dealt = open_docs.join(_dimension(blocks, few), F.col("source").eqNullSafe(F.col("b_source"))).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), "doc_id", "tie"), F.col("blocks"))
    )
    gathered = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("size", *[f for f in fields if f != "size"])), asc=False).alias("docs"))
    first = F.get("docs", F.lit(0))
    zero = F.struct(first.alias("cur"), F.slice("docs", 1, 0).alias("out"))
    folded = F.aggregate(F.slice("docs", F.lit(2), F.size("docs")), zero, lambda acc, x: _meet(acc, x, level))
    return gathered.select(folded.alias("f")).select("f.cur", "f.out")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) for each row of docs."""
    each = repeated(_mixed(docs, block), "rows", "nth")
    copies = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("nth") < F.col("copies") % F.col("rows"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def _mixed(docs: DataFrame, block: int) -> DataFrame:
    """doc_id, source, tie, size, rows, source_size, target and copies of all its rows together, of each different row."""
    counted = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("text").alias("tie"))
    sizes = cut(counted.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("rows")))
    goal = cut(targets(sizes))
    few = goal.count() <= MOST_BROADCAST
    goal = goal.withColumnRenamed("source", "t_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sizes.join(_dimension(goal, few), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    parted = joined.withColumn("due", F.col("rows") * ratio).withColumn("whole", F.floor("due").cast("bigint")).withColumn("part", F.col("due") - F.col("whole")).drop("due")
    parted = cut(parted)
    decided = parted.filter("part = 0 OR size = 0").withColumn("part", F.lit(0.0))
    fields = decided.columns
    left, level = parted.filter("part > 0 AND size > 0"), 0
    while True:
        folded = cut(_level(left, level, block, few))
        decided = decided.unionByName(folded.select(F.explode("out").alias("d")).select("d.*").select(*fields))
        left, level = folded.select("cur.*").select(*fields), level + 1
        most = left.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
    last = F.when(_uniform(F.lit(SEED), F.lit("last"), "doc_id", "tie") < F.col("part"), 1.0).otherwise(0.0)
    decided = decided.unionByName(left.withColumn("part", last))
    copies = (F.col("whole") + F.col("part").cast("bigint")).alias("copies")
    return decided.select("doc_id", "source", "tie", "size", "rows", "source_size", "target", copies)


def apply_mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs.

    Repeated rows (equal doc_id, source and text) occur floor(copies / rows) times
    each, and what is left of their copies are copies of one of them.
    """
    key, other, all_, rows, over, nth = fresh(docs, "mix_key", "mix_other", "mix_all", "mix_rows", "mix_over", "mix_nth")
    counts = cut(_mixed(docs, block).select(F.xxhash64("doc_id", "source", "tie").alias(other), F.col("copies").alias(all_), F.col("rows").alias(rows)))
    joined = docs.withColumn(key, F.xxhash64("doc_id", "source", F.xxhash64("text"))).join(counts, F.col(key) == F.col(other))
    out = repeated(joined.withColumn(over, F.floor(F.col(all_) / F.col(rows))), over, nth, int(MOST)).select(*docs.columns)
    left = counts.filter((F.col(rows) > 1) & (F.col(all_) % F.col(rows) > 0))
    most = left.agg(F.max(F.col(all_) % F.col(rows))).first()[0]
    if most is None:
        return out
    again = docs.withColumn(key, F.xxhash64("doc_id", "source", F.xxhash64("text"))).join(left, F.col(key) == F.col(other)).dropDuplicates([key])
    return out.unionByName(repeated(again.withColumn(over, F.col(all_) % F.col(rows)), over, nth, most).select(*docs.columns))
