"""Spelling variants by a symmetric-delete join.

Runs [A-Za-z\\u00C0-\\u00FF]+ of a text, maximal and with only A-Z lower-cased, are its
words after a fixed noise: where 31 divides the CRC-32 of ``<doc_id>:<run>``, the run
loses its code point at CRC-32 % length. Words of ``LEAST_LENGTH`` code points and
``LEAST_COUNT`` occurrences are kept; tasks count them before they shuffle.

Join: every word emits itself and its single deletions, each with the place it was made
at. Equal deletions of neighbouring places are one deletion, under its first place, where it may equal
a whole word (one word is the other with a code point more); two words of one length share a
deletion made at one place where they differ in that place alone. So the equi-joins
meet near words only, at most 90 in one replaced place (the alphabet), and no group grows with
the square of the vocabulary. Keys are 64-bit polynomial hashes, made for all places of a
word in one pass whatever its length, and rows carry two hashes of the word in place of it; the texts are
joined to what met and verified to be at distance one exactly.

A word's form is its near word of the largest count, ties going to the smallest in
code-point order, if that count is ``TIMES`` the word's or more. Counts grow
along forms, so there is no cycle; roots are found by pointer doubling.

Defined results: a null text has no words; a null doc_id is an empty string in the noise; repeated rows
count each; words that are near to none have n_near 0 and are their own root; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvestat.llm.common import cut

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
NOISE = 31
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Code points whose deletions are made at once.
BLOCK = 1 << 18
SEED = 11

#: UTF-8 of a run long enough to be a word: U+00C0 to U+00FF are the bytes C3 80 to C3 BF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % LEAST_LENGTH)

_DRAW = np.random.default_rng(SEED)
_VALUE = _DRAW.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_DRAW.integers(0, 1 << 62, dtype=np.int64)) * 4 + 3
_BASE_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_PLACE, _LENGTH = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

REPLACED, DELETED, WHOLE = 0, 1, 2


def noisy(run: bytes, start: int) -> bytes:
    """A lower-cased run after the noise; start: CRC-32 of the document's prefix."""
    h = crc32(run, start)
    if h % NOISE:
        return run
    if run.isascii():
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _long_enough(word: bytes) -> bool:
    return len(word) - word.count(b"\xc3") >= LEAST_LENGTH


def _counts(docs: DataFrame) -> DataFrame:
    """Rows (word, n) of partial counts."""

    def told(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                start, text = crc32(batch.column(0)[at].as_py() + b":"), batch.column(1)[at].as_py()
                for match in _RUN.finditer(text.lower()):  # bytes: lower-cases A-Z only
                    word = noisy(match[0], start)
                    counts[word] = counts.get(word, 0) + 1
                    if len(counts) > HELD:
                        yield told({w: n for w, n in counts.items() if _long_enough(w)})
                        counts = {}
        yield told({w: n for w, n in counts.items() if _long_enough(w)})

    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return docs.filter("text IS NOT NULL").select(id_.alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "word string, n bigint")


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n and two hashes h1, h2 that stand for the word in joins."""
    words = _counts(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    return cut(words.withColumns({"h1": F.xxhash64("word"), "h2": F.xxhash64(F.lit(SEED), "word")}))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE % (1 << 64), dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def deletions(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """Keys of words given in Latin-1: (owner, key) of each place's deletion with its place, of the distinct deletions, and the key of each whole word."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    code = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(code)) - starts[owner]
    term = _VALUE[code] * _powers(int(lengths.max(initial=0)))[place]
    before = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(term, dtype=np.uint64)])
    left = before[:-1] - before[starts][owner]
    right = (before[ends][owner] - before[1:]) * _BASE_INVERSE
    shorter = left + right
    size = (lengths.astype(np.uint64) * _LENGTH)[owner]
    replaced = _mixed(shorter + size + (place.astype(np.uint64) + np.uint64(1)) * _PLACE)
    first = np.ones(len(code), dtype=bool)
    first[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    deleted = _mixed(shorter[first] + size[first] - _LENGTH)
    whole = _mixed(before[ends] - before[starts] + lengths.astype(np.uint64) * _LENGTH)
    return owner, replaced, owner[first], deleted, whole


def emitted(words: DataFrame) -> DataFrame:
    """Rows (kind, key, h1, h2) of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            latin = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            h = [batch.column(i).to_numpy() for i in (1, 2)]
            ends = np.cumsum([len(w) for w in latin]) if latin else np.empty(0, dtype=np.int64)
            at = 0
            while at < len(latin):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
                owner, replaced, of, deleted, whole = deletions(latin[at:to])
                of_each = np.concatenate([owner, of, np.arange(to - at)]) + at
                kind = np.repeat(np.array([REPLACED, DELETED, WHOLE], dtype=np.int32), [len(replaced), len(deleted), len(whole)])
                key = np.concatenate([replaced, deleted, whole])
                for part in range(0, len(key), BLOCK):
                    own = slice(part, part + BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind[own], key[own], h[0][of_each[own]], h[1][of_each[own]])], names=["kind", "key", "h1", "h2"])
                at = to

    return words.select("word", "h1", "h2").mapInArrow(run, "kind int, key bigint, h1 bigint, h2 bigint")


def near_words(words: DataFrame) -> DataFrame:
    """Each ordered pair of words at distance one: word, other and the other's count."""
    rows = cut(emitted(words))
    side = lambda kind, p: rows.filter(F.col("kind") == kind).select("key", F.col("h1").alias(f"{p}1"), F.col("h2").alias(f"{p}2"))
    replaced = side(REPLACED, "a").join(side(REPLACED, "b"), "key").filter("a1 <> b1 OR a2 <> b2")
    longer = side(DELETED, "a").join(side(WHOLE, "b"), "key")
    ends = ["a1", "a2", "b1", "b2"]
    met = replaced.select(*ends).unionByName(longer.select(*ends)).unionByName(longer.select(F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("b1").alias("a1"), F.col("b2").alias("a2")))
    named = lambda p, word, n: words.select(F.col("h1").alias(f"{p}1"), F.col("h2").alias(f"{p}2"), F.col("word").alias(word), F.col("n").alias(n))
    pairs = met.join(named("b", "other", "other_n"), ["b1", "b2"]).join(named("a", "word", "n"), ["a1", "a2"])
    return pairs.filter(F.levenshtein("word", "other", 1) == 1).select("word", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each word that has a form (word, form)."""
    state = cut(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        moved = cut(state.join(further, F.col("root") == F.col("at"), "left"))
        if moved.filter("at IS NOT NULL").isEmpty():
            return state
        state = cut(moved.select("word", F.coalesce("beyond", "root").alias("root")))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs."""
    words = vocabulary(docs)
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    is_form = -F.col("best.n") >= TIMES * F.col("n")
    formed = cut(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")
        )
    )
    out = formed.join(roots(formed), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
