"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: ASCII lower case, words [^\\x20\\x09-\\x0D]+, shingles of three
words with repeats; a bit is 1 if it is set in over half of the shingles'
XXH64 (seed 42). A text of one or two words is one shingle; a text without
words, and a null text, has fingerprint zero and links like any other.

Links: fingerprints at two or fewer differing bits. A fingerprint is cut into
three segments. Two errors leave at least one segment exact (pigeonhole), and
the next segment, read as a word of the Golay code, is decoded to all nearby
codewords, which two segments at two or fewer errors always share one of. So a
fingerprint has at most 18 keys of (exact segment, codeword), and every linked
pair meets under one. Equal fingerprints are one node from the start.

Fingerprints that meet under a key are joined and verified by bit count. A key
of two is verified as it is counted. Up to ``GROUP`` under one key are compared
in one row, which yields one edge for each fingerprint linked to others, never
the pairs. More are dealt anew by the third segment's codewords, which linked
ones share as well. Groups that are still larger, far more than chance brings
together, hold fingerprints within a few bits of each other: there each is written
under the 65 values within one bit of it; two within two bits always share
such a value, at most 65 can meet there, all within two bits, so a star of edges
replaces their pairs. ``routes`` counts the keys of each kind.

Defined results: repeated rows get one component; a null doc_id gets its
component's smallest doc_id like any other row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvestat.llm import golay, near_copies
from curvestat.llm.common import cut, few, fresh
from curvestat.llm.graph import components

SEED = 42
SHINGLE = 3
BITS = 2
#: First bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are compared in one row.
GROUP = 256
#: Rows of two longs up to which a table is broadcast.
MOST_BROADCAST = 500_000
#: Shingles hashed at once, which bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of a text's UTF-8 bytes."""
    from xxhash import xxh64_intdigest

    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) < SHINGLE:
        return xxh64_intdigest(b" ".join(w), SEED)
    n = len(w) - SHINGLE + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = w[at : at + BLOCK + SHINGLE - 1]
        grams = map(b" ".join, zip(part, part[1:], part[2:], strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _keyed(distinct: DataFrame) -> DataFrame:
    """Rows (key, fp): the keys of each fingerprint."""
    table = golay.patterns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            bits = fp.view(np.uint64)
            parts = [((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
            out = []
            for i, exact in enumerate(parts):
                near = golay.keys(parts[(i + 1) % len(parts)], table)
                out.append((i << 36) | (exact[:, None] << 12) | near)
            key = np.concatenate(out, axis=1)
            fresh = np.ones_like(key, dtype=bool)
            for j in range(1, 6):  # a segment with one codeword has it six times
                fresh[:, j::6] = key[:, j::6] != key[:, ::6]
            yield pa.RecordBatch.from_arrays([pa.array(key[fresh]), pa.array(np.broadcast_to(fp[:, None], key.shape)[fresh])], names=["key", "fp"])

    return distinct.mapInArrow(run, "key bigint, fp bigint")


def _dealt_anew(keyed: DataFrame) -> DataFrame:
    """Rows (key, fp) under keys of all three segments: the key they had and a codeword near the third segment."""
    table = golay.patterns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            third = np.empty(len(fp), dtype=np.int64)
            for i in range(len(SEGMENTS)):
                at, width = SEGMENTS[(i + 2) % len(SEGMENTS)]
                own = key >> 36 == i
                third[own] = (fp[own].view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
            near = golay.keys(third, table)
            fresh = np.ones_like(near, dtype=bool)
            fresh[:, 1:] = near[:, 1:] != near[:, :1]
            further = (key[:, None] << 12) | near
            yield pa.RecordBatch.from_arrays([pa.array(further[fresh]), pa.array(np.broadcast_to(fp[:, None], near.shape)[fresh])], names=["key", "fp"])

    return keyed.select("key", "fp").mapInArrow(run, "key bigint, fp bigint")


def _verified(groups: DataFrame) -> DataFrame:
    """Edges (a, b) from each fingerprint of a group (fps: array) to the least it is linked to, through others or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for m in np.unique(sizes[sizes > 1]):
                starts = ends[sizes == m] - m
                step = max(1, (1 << 20) // int(m * m))  # groups of one size that are compared at once
                for at in range(0, len(starts), step):
                    fp = np.sort(flat[starts[at : at + step, None] + np.arange(m)], axis=1)
                    linked = np.bitwise_count((fp[:, :, None] ^ fp[:, None, :]).view(np.uint64)) <= BITS
                    low = np.broadcast_to(np.arange(m), fp.shape)
                    while True:
                        new = np.where(linked, low[:, None, :], m).min(axis=2)
                        if (new == low).all():
                            break
                        low = new
                    moved = low != np.arange(m)
                    out.append((np.take_along_axis(fp, low, axis=1)[moved], fp[moved]))
            a, b = (np.concatenate([x[i] for x in out]) if out else np.empty(0, dtype=np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return groups.select("fps").mapInArrow(run, "a bigint, b bigint")


def _met(keyed: DataFrame) -> DataFrame:
    """Keys of two and more fingerprints: key, n, and the least and greatest of them."""
    return cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))


def _grouped(keyed: DataFrame, met: DataFrame) -> DataFrame:
    """Groups of keys of three to GROUP fingerprints."""
    keys = met.filter(F.col("n").between(3, GROUP)).select("key")
    return keyed.join(few(keys, MOST_BROADCAST), "key", "left_semi").groupBy("key").agg(F.collect_list("fp").alias("fps"))


def _stages(distinct: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Keyed rows and keys met, by two segments and, of the crowded keys, by three."""
    keyed = _keyed(distinct)
    met = _met(keyed)
    large = met.filter(F.col("n") > GROUP).select("key")
    anew = cut(_dealt_anew(keyed.join(few(large, MOST_BROADCAST), "key", "left_semi")))
    return keyed, met, anew, _met(anew)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links of the distinct fingerprints fp."""
    keyed, met, anew, met_anew = _stages(distinct)
    two = met.unionByName(met_anew).filter("n = 2").select("a", "b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)
    compared = _verified(_grouped(keyed, met).unionByName(_grouped(anew, met_anew)))
    dense = anew.join(few(met_anew.filter(F.col("n") > GROUP).select("key"), MOST_BROADCAST), "key", "left_semi").select("fp").distinct()
    one_bit = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    around = dense.select("fp", F.explode(F.transform(one_bit, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    stars = around.groupBy("mid").agg(F.collect_list("fp").alias("near")).filter(F.size("near") > 1)
    star = stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    return two.unionByName(compared).unionByName(star).distinct()


def routes(distinct: DataFrame) -> dict[str, int]:
    """Keys by how their fingerprints are verified: as they are counted, in one row, dealt anew, through neighbours."""
    _, met, _, met_anew = _stages(distinct)
    count = lambda table: table.agg(*[F.count(F.when(test, 1)).alias(name) for name, test in (("two", F.col("n") == 2), ("row", F.col("n").between(3, GROUP)), ("large", F.col("n") > GROUP))]).first()
    first, then = count(met), count(met_anew)
    return {"two": first["two"] + then["two"], "row": first["row"] + then["row"], "anew": first["large"], "neighbours": then["large"]}


def _resolved(base: DataFrame) -> DataFrame:
    """n_fp and component_id of each fingerprint of base (doc_id, fp)."""
    nodes = cut(base.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes.select("fp")))
    lows = nodes.join(roots, F.col("fp") == F.col("node"))
    least = lows.groupBy("root").agg(F.min("low").alias("least"), F.min("fp").alias("group"))
    linked = lows.join(least, "root").select(F.col("fp").alias("l_fp"), "least", "group")
    # cut, so that the joins with it read two plain shuffles and a fingerprint shared by many documents can be split
    return cut(nodes.join(linked, F.col("fp") == F.col("l_fp"), "left").select(F.col("fp").alias("n_fp"), F.coalesce("least", "low").alias("component_id"), F.coalesce("group", "fp").alias("group")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs."""
    base = cut(fingerprints(docs))
    named = base.join(_resolved(base), F.col("fp") == F.col("n_fp"))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _content(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, fp, and the size of the set, bands and sketch of near_copies, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            fp = np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64)
            sets = [near_copies.shingles(x) for x in texts]
            signs = [near_copies.signature(x) for x in sets]
            columns = [pa.array(fp), pa.array([len(x) for x in sets], pa.int64()), pa.array([x[0] for x in signs], pa.list_(pa.int64())), *[pa.array([x[1][i] for x in signs], pa.int64()) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["row_key", "doc_id", "fp", "n", "bands", "s1", "s2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(_row_key(), "doc_id", F.col("text").cast("binary"))
    return rows.mapInArrow(run, f"row_key bigint, doc_id {kind}, fp bigint, n bigint, bands array<bigint>, s1 bigint, s2 bigint")


def _sets(docs: DataFrame, row_keys: DataFrame) -> DataFrame:
    """row_key, doc_id and set of near_copies of the rows of docs with one of row_keys; repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [near_copies.shingles(x).view(np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int32()))], names=["row_key", "doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(_row_key(), "doc_id", F.col("text").cast("binary")).join(few(row_keys, MOST_BROADCAST), "row_key", "left_semi")
    return rows.mapInArrow(run, f"row_key bigint, doc_id {kind}, shingles array<int>").dropDuplicates(["row_key"])


def _row_key() -> Column:
    return F.xxhash64("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("row_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component that has no near copy before it; the columns of docs.

    A component's row is that of the smallest doc_id, and of several contents with
    that doc_id the one of the smallest hash. Of repeated rows one stays. Rows
    without a doc_id stand after all others; a component of such rows only keeps
    one of each content. Of these rows those with a near copy (near_copies) go.

    The rows that go are taken out by an anti-join with their keys; whole texts are
    shuffled only where these keys are too many to broadcast.
    """
    base = cut(_content(docs))
    named = base.select("row_key", "doc_id", "fp").join(_resolved(base), F.col("fp") == F.col("n_fp"))
    first = named.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    per = F.when(F.col("doc_id").isNull(), F.col("row_key")).otherwise(F.lit(0))
    chosen = cut(first.groupBy("group", per.alias("per")).agg(F.min("row_key").alias("row_key")).select("row_key"))
    counts = base.groupBy("row_key").agg(F.count("*").alias("copies"))
    seen = cut(counts.join(chosen.withColumn("is_chosen", F.lit(True)), "row_key", "left"))
    repeated = cut(seen.filter("is_chosen AND copies > 1").select("row_key"))
    rows = base.join(chosen, "row_key", "left_semi")
    if not repeated.isEmpty():
        single = rows.join(few(repeated, MOST_BROADCAST), "row_key", "left_anti")
        rows = single.unionByName(rows.join(few(repeated, MOST_BROADCAST), "row_key", "left_semi").dropDuplicates(["row_key"]))
    near = near_copies.lost(cut(rows), lambda row_keys: _sets(docs, row_keys))
    gone = cut(seen.filter("is_chosen IS NULL").select("row_key").unionByName(near).distinct())
    (key,) = fresh(docs, "content_key")
    named_so = lambda table: few(table.select(F.col("row_key").alias(key)), MOST_BROADCAST)
    kept = docs.withColumn(key, _row_key()).join(named_so(gone), key, "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    single = kept.join(named_so(repeated), key, "left_anti")
    again = kept.join(named_so(repeated), key, "left_semi").dropDuplicates([key])
    return single.unionByName(again).select(*docs.columns)
