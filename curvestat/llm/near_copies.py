"""Near copies: pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Sets hold 32 bits of the XXH64 of each shingle of the ASCII lower-case words; a
text of fewer than five words is one shingle. Candidates meet in one of 20 bands
of five minima of random hashes: a pair at 0.8 meets with probability 0.9996, at
0.9 with more than 1 - 1e-7. Candidates are verified on the whole sets.

Order: (null doc_id last, doc_id, row_key). A row is lost when it met a similar
one before it. Bands are counted first; two rows alone in one are a pair, and of
fuller ones only the rows are gathered. Every such row is first compared with the
earliest row that it met, one pair a row, which takes most rows of a large group of near
copies away. Rows that are left and still meet others are brought together with their
sets where these are up to ``ROWS_TOGETHER`` rows and ``SHINGLES_TOGETHER`` shingles, the same
rows of several bands once, and compared with each other in one task, which
yields lost rows, not pairs. In larger bands leaders are compared with all
others; they and the lost rows leave the band, until it is small enough, with twice as
many leaders each time. So any two rows that are left and met were compared.

Pairs of the first and the last kind are verified only where sketches of 100 bits, one of each
minimum, differ in ``SKETCH`` or fewer: a pair at 0.8 is expected to differ in
10, with a deviation of 3, so it is passed over with a probability near 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvestat.llm.common import cut, few

WIDTH = 5
LIKE = 0.8
BANDS, ROWS = 20, 5
SEED = 42
#: Rows, and shingles of their sets, that are compared in one task.
ROWS_TOGETHER, SHINGLES_TOGETHER = 1024, 1 << 20
#: Shingles that one step of the comparison goes through.
COLUMNS = 1 << 12
SKETCH = 26
#: Rows of two longs up to which a table is broadcast.
MOST_BROADCAST = 500_000
#: Shingles hashed by all functions at once, which bounds memory for long texts.
BLOCK = 1 << 12

_DRAW = np.random.default_rng(SEED)
_FACTOR = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_BIT = np.uint64(20)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; none without words."""
    from xxhash import xxh64_intdigest

    w = (text or b"").lower().split()
    grams = map(b" ".join, zip(*[w[i:] for i in range(WIDTH)], strict=False)) if len(w) >= WIDTH else [b" ".join(w)] if w else []
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64).astype(np.uint32))


def signature(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands, none for an empty set, and the sketch as two longs."""
    from xxhash import xxh64_intdigest

    if not len(shingle):
        return np.empty(0, dtype=np.int64), np.zeros(2, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    # spread over 64 bits first; the functions then differ in their high bits
    spread = shingle.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    for at in range(0, len(spread), BLOCK):
        h = (spread[at : at + BLOCK] ^ _SHIFT[:, None]) * _FACTOR[:, None]
        least = np.minimum(least, h.min(axis=1))
    keys = np.array([xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)
    bits = np.zeros(128, dtype=np.uint8)
    bits[: len(least)] = (least >> _BIT) & np.uint64(1)
    return keys, np.packbits(bits).view(np.int64)


def _alike(x: Column, y: Column) -> Column:
    return F.bit_count(x["s1"].bitwiseXOR(y["s1"])) + F.bit_count(x["s2"].bitwiseXOR(y["s2"])) <= SKETCH


def _led(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """Rows (key, r) with the leaders l of their band that come before or after them and have a sketch like theirs."""
    joined = rows.join(few(leaders.withColumnRenamed("key", "l_key"), MOST_BROADCAST), F.col("key") == F.col("l_key"))
    return joined.filter(F.col("r.row") != F.col("l.row")).filter(_alike(F.col("r"), F.col("l")))


def _leaders(rows: DataFrame, many: int) -> DataFrame:
    """The first row l of each band (key), or that of each of so many classes of its rows."""
    kind = F.pmod(F.xxhash64(F.lit(many), "r.row.row_key"), F.lit(many))
    return cut(rows.groupBy("key", kind.alias("kind")).agg(F.min("r").alias("l")).select("key", "l"))


def later_alike(sets: list[np.ndarray]) -> np.ndarray:
    """Which of the sets have a similar one before them."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(count[count > 1].size), COLUMNS):
        own = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[owner[own], column[own] - at] = 1
        both += held @ held.T
    like = both >= LIKE * (sizes[:, None] + sizes - both)
    return np.tril(like, -1).any(axis=1)


def _compared(groups: DataFrame) -> DataFrame:
    """row_key of the rows of each group (g: place and shingles in order) with a similar one before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([], pa.int64())
            out = []
            for at in range(batch.num_rows):
                keys, sets = batch.column(0)[at].values, batch.column(1)[at].values
                late = later_alike([sets[i].values.to_numpy(zero_copy_only=False) for i in range(len(sets))])
                out.append(keys.filter(pa.array(late)))
            rows = pa.concat_arrays(out) if out else rows
            yield pa.RecordBatch.from_arrays([rows], names=["row_key"])

    return groups.select("g.place.row_key", "g.shingles").mapInArrow(run, "row_key bigint")


def lost(rows: DataFrame, sets_of) -> DataFrame:
    """row_key of the rows (row_key, doc_id, n, bands, s1, s2; row_key unique) that go for a similar one before them.

    n: size of the set. sets_of: row_key, doc_id and shingles of a table of row_keys; called once, for all candidates.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    met = rows.select("row_key", F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("met"), F.min("row_key").alias("a"), F.max("row_key").alias("b"))
    met = cut(met.filter("met > 1"))
    couples = met.filter("met = 2").select("a", "b")
    full = few(met.filter("met > 2").select("key"), MOST_BROADCAST)
    left = cut(rows.select(F.struct(place.alias("row"), "s1", "s2").alias("r"), "n", F.explode("bands").alias("key")).join(full, "key", "left_semi"))
    candidates = couples.select(F.col("a").alias("row_key")).unionByName(couples.select(F.col("b").alias("row_key"))).unionByName(left.select("r.row.row_key"))
    sets = cut(sets_of(cut(candidates.distinct())).select(place.alias("place"), "shingles"))

    def similar(pairs: DataFrame) -> DataFrame:
        """row_key of the later row of each similar pair of row_keys (a, b)."""
        each = few(cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), MOST_BROADCAST)
        one = each.join(sets.select(F.col("place").alias("x_place"), F.col("shingles").alias("x")), F.col("a") == F.col("x_place.row_key")).select("b", "x_place", "x")
        two = one.join(sets, F.col("b") == F.col("place.row_key")).filter(F.size("shingles").between(LIKE * F.size("x"), F.size("x") / LIKE))
        both = F.size(F.array_intersect("x", "shingles"))
        return cut(two.filter(both >= LIKE * (F.size("x") + F.size("shingles") - both)).select(F.greatest("place", "x_place").getField("row_key").alias("row_key")).distinct())

    def together(small: DataFrame) -> DataFrame:
        """row_key of the later row of each similar pair in the bands small (key, r)."""
        members = small.groupBy("key").agg(F.sort_array(F.collect_list("r.row.row_key")).alias("members"))
        groups = members.groupBy(F.xxhash64("members").alias("group"), F.size("members").alias("m")).agg(F.first("members").alias("members"))
        rows = cut(groups.select("group", "m", F.explode("members").alias("member")))
        gathered = rows.join(sets, F.col("member") == F.col("place.row_key")).groupBy("group", "m").agg(F.sort_array(F.collect_list(F.struct("place", "shingles"))).alias("g"))
        return cut(_compared(gathered).distinct())

    first = _led(left, _leaders(left, 1)).groupBy("r.row.row_key").agg(F.min("l.row").alias("l")).select(F.col("l.row_key").alias("a"), F.col("row_key").alias("b"))
    out, many = [similar(couples.unionByName(first))], 2
    compared = left.select("key", F.col("r.row.row_key").alias("row_key")).limit(0)
    while True:
        rest = left.withColumn("row_key", F.col("r.row.row_key")).join(few(out[-1], MOST_BROADCAST), "row_key", "left_anti").join(compared, ["key", "row_key"], "left_anti")
        rest = cut(rest.select("key", "r", "n"))
        sizes = cut(rest.groupBy("key").agg(F.count("*").alias("met"), F.sum("n").alias("volume")).filter("met > 1"))
        is_small = (F.col("met") <= ROWS_TOGETHER) & (F.col("volume") <= SHINGLES_TOGETHER)
        out.append(together(rest.join(few(sizes.filter(is_small).select("key"), MOST_BROADCAST), "key", "left_semi")))
        large = sizes.filter(~is_small).select("key")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, out)
        left = cut(rest.join(few(large, MOST_BROADCAST), "key", "left_semi").withColumn("row_key", F.col("r.row.row_key")).join(few(out[-1], MOST_BROADCAST), "row_key", "left_anti").select("key", "r", "n"))
        leaders = _leaders(left, many)
        out.append(similar(_led(left, leaders).select(F.col("l.row.row_key").alias("a"), F.col("r.row.row_key").alias("b"))))
        compared, many = leaders.select("key", F.col("l.row.row_key").alias("row_key")), 2 * many
