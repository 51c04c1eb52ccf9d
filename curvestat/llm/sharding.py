"""Sharding by balanced label propagation over linked documents.

Law ``rows``: shards hold equal numbers of documents, at most one apart.
Links: documents with equal texts; a text's documents all link to its *hub*, so
a group of n copies is n links and never n^2 pairs. Equal rows are counted and
placed as one row with a weight.

Every document starts in a shard by hash. In each round the documents of one
hub in one shard are a block; Spark joins find, for every hub, its neighbours'
shard: the one that holds most of its documents among those with room. Blocks
propose to move there, and proposals are accepted by hash priority up to the
shard's quota, counted in a histogram of (from, to, priority) in which moves out
make room for moves in. Quotas start above an even share and tighten. Rounds end
when no move is accepted, or when quotas have tightened and the cut edges (the
documents outside the shard that holds most of their hub) fall no further than
by ``SETTLED``. Hubs above ``BIG`` of a shard are few
(at most shards / BIG, or half the rows of a table that small) and are laid out
first, over as few shards as hold them, so no quota has to break them at random.

A last pass makes counts exact: documents get a rank in their shard, documents
without links last, and those ranked above the quota fill the shards below it
in order. Ranks come from counts of (shard, bin) and a window inside one bin.
Bins hold about ``PER_BIN`` documents at any size of the table: their number follows
it, and a hub with more than that has bins of its own.

Defined results: a null text has size 16 and no link; a null doc_id is placed
like any value; repeated rows are documents of their own; an empty table gives
an empty result; other columns of the input are ignored. Collected to the driver: only tables
of shards, of pairs of shards by priority, and of big hubs, whose sizes are fixed by the
number of shards.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvestat.llm.common import cut, fresh, let, repeated

SHARDS = 40
OVERHEAD = 16
#: Quotas of the first rounds, as multiples of an even share; the last one holds from then on.
QUOTAS = (1.25, 1.25, 1.2, 1.15, 1.1, 1.1)
BIG = 0.25
PRIORITIES = 60
PER_BIN = 20_000
SETTLED = 0.001
SEED = 3


def _by_shard(values: list, shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (shard + 1).cast("int"))


def described(docs: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """Narrow row of each different row of docs (by keys): how often it occurs, its size, CRC-32, hub, and two hashes for draws and joins."""
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text, F.lit(SEED))).alias("text_hub"),
        F.xxhash64(F.lit(SEED), *keys).alias("draw"),
        F.xxhash64(*keys).alias("check"),
    )
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("rows"))
    return counted.withColumn("first", F.pmod("draw", F.lit(shards)).cast("int"))


def _lay_out(big: list, quota: list[int]) -> tuple[dict[int, list[tuple[int, int]]], list[int]]:
    """Shards and row counts for each big hub, largest first, and the room left."""
    room, plan = list(quota), {}
    for hub, n in sorted(big, key=lambda x: (-x[1], x[0])):
        parts = []
        while n > 0:
            whole = [s for s in range(len(room)) if room[s] >= n]
            # the tightest shard that holds what is left, else the emptiest one
            s = min(whole, key=lambda i: (room[i], i)) if whole else max(range(len(room)), key=lambda i: (room[i], -i))
            take = min(n, room[s])
            if take <= 0:
                break
            parts.append((s, take))
            room[s] -= take
            n -= take
        plan[hub] = parts
    return plan, room


def _propagate(blocks: DataFrame, room: list[int], shards: int) -> DataFrame:
    """Rounds of label propagation: rows (hub, home, shard, n); home is where the block began."""
    step, before = 0, None
    while True:
        factor = QUOTAS[min(step, len(QUOTAS) - 1)]
        load = [0] * shards
        for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            load[r["shard"]] = r["n"]
        most = [int(room[s] * factor) for s in range(shards)]
        held = blocks.groupBy("hub", "shard").agg(F.sum("n").alias("n"))
        has_room = _by_shard([int(load[s] < most[s]) for s in range(shards)], F.col("shard"))
        score = F.struct(has_room.alias("open"), "n", F.pmod(F.xxhash64(F.lit(step), "hub", "shard"), F.lit(1 << 20)).alias("tie"), "shard")
        hubs = cut(held.groupBy("hub").agg(F.max(score).alias("best"), F.count("*").alias("spread"), (F.sum("n") - F.max("n")).alias("outside")).filter("spread > 1"))
        edges = hubs.agg(F.sum("outside")).first()[0] or 0
        if edges == 0 or (step >= len(QUOTAS) and edges > (1 - SETTLED) * before):
            return blocks
        best = hubs.select(F.col("hub").alias("b_hub"), F.col("best.shard").alias("to"))
        priority = F.pmod(F.xxhash64(F.lit(SEED + step), "hub"), F.lit(PRIORITIES)).cast("int")
        joined = cut(blocks.join(best, F.col("hub") == F.col("b_hub"), "left").drop("b_hub").withColumn("p", priority))
        wishes = joined.filter("to <> shard").groupBy("shard", "to", "p").agg(F.sum("n").alias("n")).collect()
        masks = _accept([(r["p"], r["shard"], r["to"], r["n"]) for r in wishes], load, most, shards)
        if not any(masks):
            return blocks
        mask = F.element_at(F.array(*[F.lit(m).cast("bigint") for m in masks]), (F.col("shard") * shards + F.coalesce("to", F.lit(0)) + 1).cast("int"))
        accepted = F.col("to").isNotNull() & (F.col("to") != F.col("shard")) & (mask.bitwiseAND(F.expr("shiftleft(1L, p)")) != 0)
        blocks = cut(joined.select("hub", "home", "size", F.when(accepted, F.col("to")).otherwise(F.col("shard")).alias("shard"), "n"))
        step, before = step + 1, edges


def _accept(wishes: list[tuple[int, int, int, int]], load: list[int], most: list[int], shards: int) -> list[int]:
    """Bit masks of accepted priorities for each (from, to); moves out make room for moves in."""
    masks = [0] * (shards * shards)
    left = sorted(wishes)
    while left:
        waiting = []
        for p, a, b, n in left:
            if load[b] + n <= most[b]:
                load[b] += n
                load[a] -= n
                masks[a * shards + b] |= 1 << p
            else:
                waiting.append((p, a, b, n))
        if len(waiting) == len(left):
            break
        left = waiting
    return masks


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    each = repeated(_placed(docs, ["doc_id", "text"], shards), "n", "nth")
    return each.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _placed(docs: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """Runs of slots of each different row of docs (by keys): its narrow columns, shard, first slot and number of slots n."""
    base = cut(described(docs, keys, shards))
    total = base.agg(F.sum("rows")).first()[0] or 0
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    hubs = cut(base.filter("text_hub IS NOT NULL").groupBy(F.col("text_hub").alias("hub"), F.col("first").alias("home")).agg(F.sum("rows").alias("n")))
    sizes = hubs.groupBy(F.col("hub").alias("s_hub")).agg(F.sum("n").alias("size")).filter("size > 1")
    big_from = max(2, int(BIG * total / shards))
    big = [(r["s_hub"], r["size"]) for r in sizes.filter(F.col("size") >= big_from).collect()]
    plan, room = _lay_out(big, quota)
    small = sizes.filter(F.col("size") < big_from)
    blocks = cut(hubs.join(small, F.col("hub") == F.col("s_hub")).select("hub", "home", "size", F.col("home").alias("shard"), "n"))
    moved = _propagate(blocks, room, shards).select(F.col("hub").alias("m_hub"), F.col("home").alias("m_home"), F.col("shard").alias("m_shard"), F.col("size").alias("m_size"))
    labelled = base.join(moved, (F.col("text_hub") == F.col("m_hub")) & (F.col("first") == F.col("m_home")), "left")
    shard, size = F.coalesce("m_shard", "first"), F.col("m_size")
    if plan:
        # a document of a big hub takes one of the hub's shards in proportion to the rows planned there
        at = F.pmod(F.xxhash64(F.lit(SEED + 100), "draw"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        picked = let(F.element_at(_big_table(plan), F.col("text_hub")), lambda choice: F.get(F.filter(choice, lambda x: at < x["until"]), F.lit(0)))
        shard, size = F.coalesce(picked["shard"], shard), F.coalesce(picked["size"], size)
    labelled = labelled.select("doc_id", "size", "text_crc32", "draw", "check", "rows", "text_hub", shard.alias("label"), size.alias("hub_size"))
    # linked documents first, one hub's together, so that the quota cuts loose documents before links
    bins = max(1, -(-total // (shards * PER_BIN)))
    own = F.col("hub_size") > PER_BIN
    inside_hub = F.when(own, F.pmod("draw", F.ceil(F.col("hub_size") / PER_BIN))).otherwise(0).cast("bigint")
    of_linked = F.struct(F.lit(0).alias("loose"), F.pmod("text_hub", F.lit(bins)).alias("bin"), F.when(own, F.col("text_hub")).otherwise(0).alias("own"), inside_hub.alias("sub"))
    of_loose = F.struct(F.lit(1).alias("loose"), F.pmod(F.xxhash64(F.lit(SEED + 7), "draw"), F.lit(bins)).alias("bin"), F.lit(0).cast("bigint").alias("own"), F.lit(0).cast("bigint").alias("sub"))
    binned = cut(labelled.withColumn("bin", F.when(F.col("hub_size").isNotNull(), of_linked).otherwise(of_loose)))
    counts = binned.groupBy("label", "bin").agg(F.sum("rows").alias("n"))
    ahead = lambda window: F.coalesce(F.sum(F.col("n")).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counts.select(F.col("label").alias("o_label"), F.col("bin").alias("o_bin"), ahead(Window.partitionBy("label").orderBy("bin")).alias("before"), "n"))
    have = [0] * shards
    for r in offsets.groupBy("o_label").agg(F.sum("n").alias("n")).collect():
        have[r["o_label"]] = r["n"]
    inside = ahead(Window.partitionBy("label", "bin").orderBy("text_hub", "draw", "check", "doc_id"))
    ranked = binned.withColumnRenamed("rows", "n").withColumn("inside", inside)
    ranked = ranked.join(offsets.drop("n"), (F.col("label") == F.col("o_label")) & (F.col("bin") == F.col("o_bin"))).withColumn("rank", F.col("before") + F.col("inside"))
    return cut(ranked.select("doc_id", "size", "text_crc32", "draw", "check", F.explode(_segments(have, quota)).alias("run")).select("*", "run.*").drop("run"))


def _segments(have: list[int], quota: list[int]) -> Column:
    """Runs (shard, slot, n) of a row with label, rank and n: below the quota in its shard; what is above it, counted through all shards, fills the gaps of the others in order."""
    shards = range(len(have))
    over = [max(0, have[s] - quota[s]) for s in shards]
    gap = [max(0, quota[s] - have[s]) for s in shards]
    over_before = [sum(over[:s]) for s in shards]
    gaps = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(sum(gap[:s])).cast("bigint").alias("begin"), F.lit(sum(gap[: s + 1])).cast("bigint").alias("end"), F.lit(have[s]).cast("bigint").alias("have")) for s in shards])
    limit, until = _by_shard(quota, F.col("label")), F.col("rank") + F.col("n")
    run = lambda shard, slot, n: F.struct(shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"), n.cast("bigint").alias("n"))
    stays = F.when(F.col("rank") < limit, F.array(run(F.col("label"), F.col("rank"), F.least(until, limit) - F.col("rank"))))
    to_spill = _by_shard(over_before, F.col("label")) - limit
    first, last = F.greatest(F.col("rank"), limit) + to_spill, until + to_spill

    def taken(g: Column) -> Column:
        begin = F.greatest(first, g["begin"])
        return run(g["shard"], g["have"] + begin - g["begin"], F.least(last, g["end"]) - begin)

    spills = F.when(until > limit, F.filter(F.transform(gaps, taken), lambda x: x["n"] > 0))
    none = F.array().cast("array<struct<shard:int,slot:bigint,n:bigint>>")
    return F.concat(F.coalesce(stays, none), F.coalesce(spills, none))


def _big_table(plan: dict[int, list[tuple[int, int]]]) -> Column:
    """Map from a big hub to its shards, each with the share of the hub's draws up to it and the hub's size."""
    entries = []
    for hub, parts in plan.items():
        size, sums = sum(n for _, n in parts), list(accumulate(n for _, n in parts))
        choice = [F.struct(F.lit(until / size).alias("until"), F.lit(shard).alias("shard"), F.lit(size).cast("bigint").alias("size")) for (shard, _), until in zip(parts, sums, strict=True)]
        entries += [F.lit(hub).cast("bigint"), F.array(*choice)]
    return F.create_map(*entries)


def add_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with columns shard and slot (clashing names are replaced).

    Equal rows are brought together once, partially before the shuffle, and are
    written out again from their runs of slots; that is the one shuffle of whole texts.
    """
    rest = docs.drop("shard", "slot")
    placed = _placed(rest, rest.columns, shards)
    key, check, row, nth, n = fresh(rest, "shard_key", "shard_check", "shard_row", "shard_nth", "shard_n")
    hashed = rest.withColumn(row, F.struct(*rest.columns)).select(row, F.xxhash64(F.lit(SEED), *rest.columns).alias(key), F.xxhash64(*rest.columns).alias(check))
    whole = hashed.groupBy(key, check).agg(F.first(row).alias(row))
    runs = placed.select(F.col("draw").alias(key), F.col("check").alias(check), "shard", "slot", F.col("n").alias(n))
    each = repeated(whole.join(runs, [key, check]), n, nth, placed.agg(F.max("n")).first()[0] or 0)
    return each.select(f"{row}.*", "shard", (F.col("slot") + F.col(nth)).alias("slot"))


def cut_edges(placed: DataFrame) -> int:
    """Documents outside the shard that holds most of their text's documents; placed: text_crc32, size and shard of each."""
    held = placed.groupBy("text_crc32", "size", "shard").agg(F.count("*").alias("n"))
    return held.groupBy("text_crc32", "size").agg((F.sum("n") - F.max("n")).alias("cut")).agg(F.sum("cut")).first()[0] or 0
