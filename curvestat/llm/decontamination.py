"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised (lower case, everything but letters, digits and marks above
ASCII becomes a space, runs of spaces become one) and get a space at either end, so
that words at the ends count as whole ones. A benchmark item is cut into windows of
``WINDOW`` characters, ``STEP`` apart and one at the end; a shorter item is one window.
A window of length m may occur with k = m * ``EDITS`` edits (spaces at the ends
not counted in m). So every passage of WINDOW + STEP characters of an item holds a window.

Filter: by the q-gram lemma an occurrence within k edits shares at least
m - q + 1 - k * q of the window's q-grams, all on diagonals (place in the
text minus place in the window) within k of each other. q is ``Q``, or less where
m / (k + 1) is, so that the bound is 1 at least for any length. Shared q-grams are
counted in overlapping bands of 2k + 1 diagonals, k + 1 apart, so some band holds
all of an occurrence's. Bands that reach the bound inside one window's length
are regions; others cannot hold an occurrence, so nothing is lost.

Verification: an exact match inside the region, or else alignment of the whole
window against the region, free at both ends of the region, in a band of
diagonals, row by row. Regions within k edits are hits.

A document is contaminated by an item when one window is hit. Defined results:
a null or empty text holds no item, a null item and one without a letter or digit
occur nowhere, repeated rows report each, empty tables give an empty result, other
columns are ignored.

Scale: the benchmark is the query set. Its size is summed first. Up to
``INDEX_CHARS`` it is one block, broadcast and indexed by each task, and the
documents are scanned once by a narrow map without a shuffle. A larger one is split by hash into blocks
of about that size; the corpus is scanned once against the set of all the items' q-grams, hashes or
a bitmap that is as large as their counted number asks for, and only documents with a stretch of them as dense as
the lemma asks for go on to the blocks one by one. The bitmap ends at 256 MB: beyond about 60 million
q-grams it passes more and more texts, which costs time and no result. Long texts are filtered in slices that
overlap by a window and a band, and places with many postings in pieces, so that items that share phrasing
don't add up in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from curvestat.llm.common import cut, few, fresh

Q = 10
WINDOW = 80
STEP = 10
EDITS = 0.075
#: Least bound of the windows whose q-grams are sought apart from those of windows that need fewer.
STRONG = 8
#: Bound on the characters of one block of the benchmark.
INDEX_CHARS = 4_000_000
#: Regions aligned at once.
TOGETHER = 512
#: Postings of the places that are looked at together, beyond two windows, and windows of these postings that are listed at once.
PIECE, EXPANDED = 200_000, 500_000
#: Characters of one slice of a batch.
SLICE = 1 << 20

_KEEP = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of the slots of a task's index.
_BITS = 22
#: The filter of a benchmark of several blocks: q-grams that are held as hashes, bits for each of more, and most bits.
MOST_EXACT, SPARSE, MOST_BITS = 4_000_000, 64, 31
#: Rows up to which a table of keys is broadcast.
MOST_BROADCAST = 500_000


def normalise(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()).decode("utf-8", "surrogatepass")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram: polynomial, with wrap-around, the same at every place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    # a gram of width a + b is gram(a) * base^b + the gram(b) behind it; widths double
    width, power, parts = 1, _BASE, []
    block, out, done = codes, None, 0
    while True:
        if q & width:
            parts.append((width, block))
        if 2 * width > q:
            break
        block = block[:-width] * np.uint64(power & _WRAP) + block[width:]
        width, power = 2 * width, power * power & _WRAP
    for w, b in reversed(parts):
        out = b[:n].copy() if out is None else out * np.uint64(pow(_BASE, w, _WRAP + 1)) + b[done : done + n]
        done += w
    return out


def bound(m: int, k: int, q: int) -> int:
    return m - q + 1 - k * q


def shape(size: int, window: int = WINDOW, edits: float = EDITS, q: int = Q) -> tuple[int, int, int, int]:
    """Length, edits, q and bound of the windows of a padded item of this size."""
    m = min(size, window)
    k = int((m if size > window else m - 2) * edits)
    q = min(q, m // (k + 1))
    return m, k, q, bound(m, k, q)


def padded(text: str | None) -> str:
    """Normalised text between spaces, or nothing."""
    body = normalise(text)
    return f" {body} " if body else ""


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def dense(at: np.ndarray, need: int, reach: int) -> np.ndarray:
    """Those of the sorted places that lie in a stretch of ``need`` of them no longer than ``reach``."""
    if len(at) < need:
        return at[:0]
    first = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= reach)
    cover = np.zeros(len(at) + 1, dtype=np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + need, -1)
    return at[np.cumsum(cover)[:-1] > 0]


class Postings:
    """q-grams of the items of one q, of a bound above STRONG or below: sorted hashes, with item and place of each."""

    def __init__(self, q: int, members: list[tuple[int, str, int, int, int]]) -> None:
        self.q = q
        hashes = [grams(_codes(body), q) for _, body, *_ in members]
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        self.hash = flat[order]
        self.item = np.repeat(np.array([m[0] for m in members], dtype=np.int32), [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes])[order]
        self.need = min(m[4] for m in members)
        self.reach = max(m[2] + m[3] for m in members) - q
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[slots(self.hash, _BITS)] = True


class Index:
    """Items of a block, their windows, and the postings of their q-grams."""

    def __init__(self, items: list[tuple], q: int = Q, window: int = WINDOW, edits: float = EDITS, step: int = STEP) -> None:
        self.step = step
        self.items, self.bodies = [], []
        shapes, groups = [], {}
        for item_id, text in items:
            body = padded(text)
            if not body:
                continue
            m, k, own_q, need = shape(len(body), window, edits, q)
            groups.setdefault((own_q, need >= STRONG), []).append((len(self.items), body, m, k, need))
            shapes.append((m, k, need))
            self.items.append(item_id)
            self.bodies.append(body)
        self.length, self.k, self.need = np.array(shapes, dtype=np.int64).reshape(-1, 3).T
        sizes = np.array([len(b) for b in self.bodies], dtype=np.int64)
        #: Windows of each item: step apart, the last one at the end of the item.
        self.last = sizes - self.length
        self.count = -(-self.last // step) + 1
        self.postings = [Postings(own_q, members) for (own_q, _), members in sorted(groups.items())]
        self.lap = 2 * int(self.length.max(initial=0)) + q

    def start(self, item: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Where the nth windows of items begin."""
        return np.minimum(nth * self.step, self.last[item])

    def windows(self) -> Iterator[tuple[int, str, int]]:
        """Item, text and edits of every window."""
        for i, body in enumerate(self.bodies):
            for j in range(int(self.count[i])):
                s = int(self.start(i, j))
                yield i, body[s : s + int(self.length[i])], int(self.k[i])

    def _counted(self, at: np.ndarray, live: "Live", h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places whose q-gram h is posted, with the first posting and their number."""
        lo = np.searchsorted(live.hash, h, "left")
        n = np.searchsorted(live.hash, h, "right") - lo
        return at[n > 0], lo[n > 0], n[n > 0]

    def regions(self, size: int, live: "Live", at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
        """Item, start of the window, and start and end of each region that reaches the bound, some items at a time.

        at: places of a text of this size, with their postings lo to lo + n. Windows are listed for at most
        ``EXPANDED`` of them together, or for one item.
        """
        posting = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        where, item, place = np.repeat(at, n), live.item[posting].astype(np.int64), live.place[posting].astype(np.int64)
        # the windows of the item that hold this place
        low = np.maximum(0, -(-(place + live.q - self.length[item]) // self.step))
        high = np.where(place >= self.last[item], self.count[item] - 1, place // self.step)
        many = np.maximum(0, high - low + 1)
        if many.sum() <= EXPANDED:
            yield self._reached(size, live, where, item, place, low, many)
            return
        order = np.argsort(item, kind="stable")
        where, item, place, low, many = (x[order] for x in (where, item, place, low, many))
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        upto, begin = np.cumsum(np.add.reduceat(many, first)), 0
        ends = np.r_[first[1:], len(item)]
        while begin < len(first):
            before = upto[begin - 1] if begin else 0
            to = max(begin + 1, int(np.searchsorted(upto, before + EXPANDED, side="right")))
            own = slice(first[begin], ends[to - 1])
            yield self._reached(size, live, where[own], item[own], place[own], low[own], many[own])
            begin = to

    def _reached(self, size: int, live: "Live", where: np.ndarray, item: np.ndarray, place: np.ndarray, low: np.ndarray, many: np.ndarray) -> list[tuple[int, int, int, int]]:
        nth = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        where, item, place = np.repeat(where, many), np.repeat(item, many), np.repeat(place, many)
        start = self.start(item, nth)
        diagonal = where - (place - start) + (1 << 40)
        # bands of 2k + 1 diagonals, k + 1 apart: each diagonal lies in one or two of them
        k = self.k[item]
        band = diagonal // (k + 1)
        both = np.flatnonzero(diagonal - band * (k + 1) < k)
        item, start, where, band = (np.concatenate((x, x[both])) for x in (item, start, where, band))
        band[len(k) :] -= 1
        order = np.lexsort((where, band, start, item))
        item, start, where, band = item[order], start[order], where[order], band[order]
        # a hit and the one need - 1 later in its band, no further apart than a window with its edits
        i = np.arange(len(item))
        j = i + self.need[item] - 1
        i, j = i[j < len(item)], j[j < len(item)]
        same = (item[i] == item[j]) & (start[i] == start[j]) & (band[i] == band[j])
        i = i[same & (where[j] - where[i] <= self.length[item[i]] + self.k[item[i]] - live.q)]
        # one region for each band
        fresh = np.ones(len(i), dtype=bool)
        fresh[1:] = (item[i][1:] != item[i][:-1]) | (start[i][1:] != start[i][:-1]) | (band[i][1:] != band[i][:-1])
        i = i[fresh]
        item, k = item[i], self.k[item[i]]
        begin = band[i] * (k + 1) - (1 << 40) - 1
        return list(zip(item.tolist(), start[i].tolist(), np.maximum(begin - k, 0).tolist(), np.minimum(begin + self.length[item] + 3 * k + 3, size).tolist(), strict=True))

    def hits(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Best window of each item found in a padded text: edits, start and end in the text without its padding.

        An item that is found without an edit is sought no further. Where its places have many postings, a text is gone
        through in pieces that overlap by a window, and the postings of found items are taken out in between.
        """
        found: dict[int, tuple[int, int, int]] = {}
        codes, exact = _codes(text), np.zeros(len(self.items), dtype=bool)

        def take(item: int, edits: int, start: int, end: int) -> None:
            if edits <= self.k[item] and (item not in found or edits < found[item][0]):
                found[item] = (edits, max(0, start - 1), min(len(text) - 2, end - 1))
                exact[item] = edits == 0

        lives = [Live(p) for p in self.postings]
        for begin in range(0, max(1, len(codes) - self.lap), SLICE):
            piece, made = codes[begin : begin + SLICE + self.lap], {}
            for live in lives:
                p = live.postings
                if p.q not in made:
                    made[p.q] = grams(piece, p.q)
                g = made[p.q]
                at = dense(np.flatnonzero(p.seen[slots(g, _BITS)]), p.need, p.reach)
                at, lo, n = self._counted(at, live, g[at])
                # the lemma's bound once more, now without places that only share a slot
                held = np.isin(at, dense(at, p.need, p.reach))
                at, lo, n = at[held], lo[held], n[held]
                while len(at):
                    upto = np.cumsum(n)
                    own = int(np.searchsorted(upto, PIECE, side="right"))
                    if own < len(at):
                        # at least two windows' places, of which the last window's are seen again
                        own = max(own, int(np.searchsorted(at, at[0] + 2 * (p.reach + 1), side="right")))
                    for regions in self.regions(len(piece), live, at[:own], lo[:own], n[:own]):
                        self._verified(text, codes, begin, regions, found, take)
                    if own >= len(at):
                        break
                    # without a place further back than that, no window's places cross the end of the piece
                    rest = int(np.searchsorted(at, at[own - 1] - p.reach, side="left")) or own
                    at, lo, n = at[rest:], lo[rest:], n[rest:]
                    if live.without(exact):
                        at, lo, n = self._counted(at, live, g[at])
        return found

    def _verified(self, text: str, codes: np.ndarray, begin: int, regions: list[tuple[int, int, int, int]], found: dict, take) -> None:
        """Hands the windows found in regions (of a piece that begins at begin) to take."""
        left: dict = {}
        for item, at, s, e in regions:
            if item in found and found[item][0] == 0:
                continue
            body = self.bodies[item][at : at + int(self.length[item])]
            exact = text.find(body, s + begin, e + begin)
            if exact >= 0:
                take(item, 0, exact, exact + len(body))
            else:
                left.setdefault((len(body), int(self.k[item])), {}).setdefault((body, text[s + begin : e + begin]), []).append((item, s + begin, e + begin))
        # regions of windows of one length are aligned together, the same window and text once
        for (m, k), pairs in left.items():
            pairs = [(key, at) for key, at in pairs.items() if any(x[0] not in found or found[x[0]][0] > 0 for x in at)]
            for first in range(0, len(pairs), TOGETHER):
                some = pairs[first : first + TOGETHER]
                edits, ends = align_many([key[0] for key, _ in some], [codes[at[0][1] : at[0][2]] for _, at in some], k)
                for (_, at), n, end in zip(some, edits.tolist(), ends.tolist(), strict=True):
                    for item, s, _ in at:
                        take(item, n, s + max(0, end - m), s + end)


class Live:
    """The postings of the items that a text has not yet been found to hold without an edit."""

    def __init__(self, postings: Postings) -> None:
        self.postings, self.q, self.gone = postings, postings.q, 0
        self.hash, self.item, self.place = postings.hash, postings.item, postings.place

    def without(self, exact: np.ndarray) -> bool:
        """Takes the postings of exact items out if twice as many items are exact as the last time; whether it did."""
        n = int(exact.sum())
        if n < max(1, 2 * self.gone):
            return False
        self.gone, stays = n, ~exact[self.item]
        self.hash, self.item, self.place = self.hash[stays], self.item[stays], self.place[stays]
        return True


def align(body: str, region: str, k: int) -> tuple[int, int]:
    """Fewest edits of body against any part of region, and the end of that part; k + 1 edits stands for more."""
    edits, ends = align_many([body], [_codes(region)], k)
    return int(edits[0]), int(ends[0])


def align_many(bodies: list[str], regions: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """``align`` of bodies of one length against a region (code points) each.

    Rows are the bodies' characters. The band of row i holds the places of a region
    within len(region) - len(body) + k of i, outside which no alignment that
    starts and ends in the region with k edits passes.
    """
    m, most = len(bodies[0]), k + 1
    size = np.array([len(x) for x in regions])[:, None]
    left, right = k, max(0, int(size.max()) - m) + k
    width = left + right + 1
    index = np.arange(width, dtype=np.int16)
    b = np.stack([_codes(x).astype(np.int32) for x in bodies])
    padded_ = np.full((len(bodies), left + 1 + max(int(size.max()), 1) + m + right + 1), -1, dtype=np.int32)
    for i, x in enumerate(regions):
        padded_[i, left + 1 : left + 1 + len(x)] = x
    # cell c of row i is place i - left + c of the region; row 0 is free
    outside = lambda i: (index + i - left < 0) | (index + i - left > size)
    row = np.where(outside(0), most, 0).astype(np.int16)
    up = np.full_like(row, most + 1)
    for i in range(1, m + 1):
        up[:, :-1] = row[:, 1:] + 1
        new = np.minimum(row + (padded_[:, i : i + width] != b[:, i - 1 : i]), up)  # the character before the place
        beyond = outside(i)
        new[beyond] = most
        # insertions: the running minimum of new - index, plus index
        new = np.minimum(np.minimum.accumulate(new - index, axis=1) + index, most)
        new[beyond] = most
        row = new.astype(np.int16)
        if row.min() > k:
            break
    ends = row.argmin(axis=1)
    return row[np.arange(len(row)), ends], m - left + ends


def blocks(benchmark: DataFrame, most: int = INDEX_CHARS) -> Iterator[list[tuple]]:
    """Items in blocks of at most about ``most`` characters, each collected alone."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // most) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    source = benchmark.filter("text IS NOT NULL").select("item_id", "text", part.alias("part"))
    for i in range(count):
        yield [(r["item_id"], r["text"]) for r in source.filter(F.col("part") == i).select("item_id", "text").collect()]


def shared_filter(benchmark: DataFrame) -> list[tuple]:
    """q, bound, reach and a set of all items' q-grams, for each q and either side of STRONG.

    q-grams are counted first. Up to ``MOST_EXACT`` of them are a sorted array of their 64-bit hashes. More are a bitmap
    with ``SPARSE`` bits for each, so that few are set by chance, but 2 to the power of MOST_BITS (256 MB) at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple[int, bool, int, int], list[np.ndarray]] = {}
            for text in batch.column(0).to_pylist():
                if body := padded(text):
                    m, k, q, need = shape(len(body))
                    out.setdefault((q, need >= STRONG, need, m + k - q), []).append(grams(_codes(body), q))
            for (q, strong, need, reach), found in out.items():
                h = np.unique(np.concatenate(found)).view(np.int64)
                fixed = [pa.array([x] * len(h)) for x in (q, strong, need, reach)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(h)], names=["q", "strong", "need", "reach", "h"])

    made = cut(benchmark.select("text").mapInArrow(run, "q bigint, strong boolean, need bigint, reach bigint, h bigint"))
    distinct = cut(made.select("q", "strong", "h").distinct())
    counts = {(r["q"], r["strong"]): r["count"] for r in distinct.groupBy("q", "strong").count().collect()}
    out = []
    for r in made.groupBy("q", "strong").agg(F.min("need").alias("need"), F.max("reach").alias("reach")).collect():
        own, n = distinct.filter((F.col("q") == r["q"]) & (F.col("strong") == r["strong"])), counts[r["q"], r["strong"]]
        if n <= MOST_EXACT:
            held = np.sort(own.select("h").toArrow().column(0).to_numpy().view(np.uint64))
        else:
            held = _bitmap(own, min(MOST_BITS, (SPARSE * n - 1).bit_length()))
        out.append((r["q"], r["need"], r["reach"], n <= MOST_EXACT, held))
    return out


def _bitmap(grams_: DataFrame, bits: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(slots(batch.column(0).to_numpy().view(np.uint64), bits))
            word, first = np.unique(at >> 6, return_index=True)
            set_ = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(set_.view(np.int64))], names=["word", "bits"])

    bitmap = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words = cut(grams_.select("h").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")))
    parts = max(1, len(bitmap) >> 20)
    for i in range(parts):  # some words at a time
        rows = words.filter(F.pmod("word", F.lit(parts)) == i).toArrow()
        bitmap[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return bitmap


def _held(h: np.ndarray, is_exact: bool, held: np.ndarray) -> np.ndarray:
    if is_exact:
        return held[np.minimum(np.searchsorted(held, h), len(held) - 1)] == h if len(held) else np.zeros(len(h), dtype=bool)
    at = slots(h, (len(held) * 64 - 1).bit_length())
    return (held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def suspicious(text: str, kinds: list[tuple]) -> bool:
    """Whether a padded text has a stretch of the items' q-grams as dense as the lemma asks for."""
    codes = _codes(text)
    return any(len(dense(np.flatnonzero(_held(grams(codes, q), is_exact, held)), need, reach)) for q, need, reach, is_exact, held in kinds)


def _filtered(docs: DataFrame, columns: list[str], keep) -> DataFrame:
    """Rows of the given columns of docs whose padded text (the column ``text``) keep() takes; keep() is made once a task."""
    source = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch], at=columns.index("text")) -> Iterator[pa.RecordBatch]:
        test = keep()
        for batch in batches:
            yield batch.filter(pa.array([test(padded(x)) for x in batch.column(at).to_pylist()], pa.bool_()))

    return source.mapInArrow(run, source.schema)


def _scanned_once(spark: SparkSession, docs: DataFrame, columns: list[str], benchmark: DataFrame) -> DataFrame:
    """The rows of docs that may hold an item of a benchmark of several blocks; kept, as each block reads them."""
    shared = spark.sparkContext.broadcast(shared_filter(benchmark))
    return cut(_filtered(docs, columns, lambda: lambda x: bool(x) and suspicious(x, shared.value)))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, most: int = INDEX_CHARS) -> DataFrame:
    """One row for each document and item found in it: edits, start and end in the normalised text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType
    item_kind = item_type.simpleString()
    schema = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("item_id", to_arrow_type(item_type)), ("edits", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    source, several, out = docs.select("doc_id", "text"), _size(benchmark) > most, None
    if several:
        source = _scanned_once(spark, docs, ["doc_id", "text"], benchmark)
    for items in blocks(benchmark, most):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = Index(shared.value)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(doc_id, ix.items[i], *hit) for i, hit in sorted(ix.hits(padded(text)).items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(5)], schema=schema)

        found = source.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, edits int, start bigint, end bigint")
        if several:  # found before the next block is made, so that one block is held at a time
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _size(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.length("text"))).first()[0] or 0


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, most: int = INDEX_CHARS) -> DataFrame:
    """The rows of docs in which no benchmark item is found, with the columns of docs.

    With one block the verdict is made in the narrow map that yields the rows. With
    several, the keys of the texts found by each are taken out by an anti-join.
    """
    if _size(benchmark) <= most:
        (items,) = blocks(benchmark, most)
        shared = spark.sparkContext.broadcast(items)

        def clean():
            ix = Index(shared.value)
            return lambda x: not ix.hits(x)

        return _filtered(docs, docs.columns, clean)
    (key,) = fresh(docs, "text_key")
    left = _scanned_once(spark, docs.filter("text IS NOT NULL"), ["text"], benchmark).withColumn(key, F.xxhash64("text"))
    gone = None
    for items in blocks(benchmark, most):
        shared = spark.sparkContext.broadcast(items)

        def dirty(shared=shared):
            ix = Index(shared.value)
            return lambda x: bool(ix.hits(x))

        found = cut(_filtered(left, ["text", key], dirty).select(key))
        shared.destroy()
        gone = found if gone is None else gone.unionByName(found)
    return docs.withColumn(key, F.xxhash64("text")).join(few(cut(gone.distinct()), MOST_BROADCAST), key, "left_anti").select(*docs.columns)
