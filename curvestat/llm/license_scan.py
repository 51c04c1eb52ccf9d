"""Licence scan by a positional rare-token index.

Texts become words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after ASCII lower case.
The document frequency of each licence word is counted over all documents, which
gives its IDF. A template's *anchors* are its words with the highest IDF (``ANCHORS`` of them at most). The index maps
an anchor to its templates and offsets.

A file's licence words are looked up; a template is tried where the file holds ``QUORUM`` of its anchors. Their postings
are intersected by relative position: a start (place in the file minus offset in the template) is a candidate where
so many different anchors agree within twice the template's slack, ``SLACK`` words and one in ``DRIFT``. A candidate is kept when its
window holds at least ``SHARE`` of the template's words and, of every group of mandatory key phrases, one; a group gives a phrase of two
or three words in several alternatives, so that altered words elsewhere lose nothing. Its label is then added. Some templates name phrases that
rule them out, such as the third clause for a text of two.

Base phrases (``BASE``) are found exactly and always labelled. The score is the
share of template words found in the best verified window, 1 for a base phrase,
0 without either.

Defined results: a null text counts as empty; repeated rows are scanned each;
an empty table gives an empty result; other columns are ignored. Memory is
bounded by one Arrow batch; the index is a few hundred entries.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvestat.llm.license_texts import TEMPLATES

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

ANCHORS = 8
QUORUM = 0.5
SLACK, DRIFT = 2, 8
SHARE = 0.6

_UPPER = bytes(range(0x41, 0x5B))
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if c in _UPPER else 0x20 for c in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def key_phrases(group: str) -> re.Pattern[bytes]:
    """Pattern of phrases parted by |: words joined by - stand side by side, between others one word may stand."""
    gap = rb"(?: [^ ]+)? "
    phrase = lambda p: gap.join(b" ".join(map(re.escape, split_words(part.encode()))) for part in p.split())
    return re.compile(rb" (?:%b) " % b"|".join(map(phrase, group.split("|"))))


class Index:
    """Templates, and the postings of their anchors by the words' document frequency."""

    def __init__(self, frequency: dict[bytes, int], templates=TEMPLATES, anchors: int = ANCHORS) -> None:
        self.labels = [label for label, *_ in templates]
        self.bodies = [split_words(text.encode()) for _, text, *_ in templates]
        self.counts = [Counter(body) for body in self.bodies]
        self.slack = [SLACK + len(body) // DRIFT for body in self.bodies]
        self.keys = [[key_phrases(g) for g in groups] for _, _, groups, *_ in templates]
        self.barred = [[key_phrases(g) for g in barred] for _, _, _, *barred in templates]
        # highest IDF first
        place = lambda w: (frequency.get(w, 0), w)
        self.anchors = [sorted(set(body), key=place)[:anchors] for body in self.bodies]
        self.quorum = [ceil(QUORUM * len(rare)) for rare in self.anchors]
        self.offsets = [{w: [o for o, x in enumerate(body) if x == w] for w in rare} for body, rare in zip(self.bodies, self.anchors, strict=True)]
        self.templates: dict[bytes, list[int]] = defaultdict(list)
        for t, rare in enumerate(self.anchors):
            for x in rare:
                self.templates[x].append(t)
        self.words = frozenset(self.templates)

    def candidates(self, w: list[bytes]) -> Iterator[tuple[int, int]]:
        """(template, start) at which a quorum of the template's anchors agrees within twice its slack."""
        met = self.words.intersection(w)
        held = Counter(t for x in met for t in self.templates[x])
        tried = sorted(t for t, n in held.items() if n >= self.quorum[t])
        if not tried:
            return
        places: dict[bytes, list[int]] = defaultdict(list)
        wanted = met.intersection(x for t in tried for x in self.anchors[t])
        for p, x in enumerate(w):
            if x in wanted:
                places[x].append(p)
        for t in tried:
            starts = sorted((p - o, x) for x in self.anchors[t] if x in met for p in places[x] for o in self.offsets[t][x])
            agree, end, last = Counter(), 0, None
            for s, x in starts:
                while end < len(starts) and starts[end][0] <= s + 2 * self.slack[t]:
                    agree[starts[end][1]] += 1
                    end += 1
                # windows reach a slack beyond either end, so starts side by side needn't all be tried
                if len(agree) >= self.quorum[t] and (last is None or s > last + self.slack[t] // 2):
                    last = s
                    yield t, s
                agree[x] -= 1
                if not agree[x]:
                    del agree[x]

    def verify(self, w: list[bytes], t: int, start: int) -> float:
        """Share of the template's words in the window, or 0 if a group of key phrases or too much is missing."""
        window = w[max(0, start - self.slack[t]) : max(0, start + len(self.bodies[t]) + 2 * self.slack[t])]
        share = sum((self.counts[t] & Counter(window)).values()) / len(self.bodies[t])
        if share < SHARE:
            return 0.0
        joined = b" %b " % b" ".join(window)
        return share if all(g.search(joined) for g in self.keys[t]) and not any(g.search(joined) for g in self.barred[t]) else 0.0


def base_places(w: list[bytes]) -> dict[str, list[int]]:
    """Starts of each base phrase, in words."""
    joined = b" %b " % b" ".join(w)
    found = {}
    for phrase in BASE:
        needle, places = b" %b " % phrase.encode(), []
        at, counted, n = joined.find(needle), 0, 0
        while at >= 0:
            n += joined.count(b" ", counted, at)
            counted = at
            places.append(n)
            at = joined.find(needle, at + 1)
        if places:
            found[phrase] = places
    return found


def scan(text: bytes | None, index: Index) -> tuple:
    w = split_words(text)
    base = base_places(w)
    starts = [x for places in base.values() for x in places]
    labels = {BASE[p] for p in base}
    score, added = (1.0 if base else 0.0), set()
    for t, s in index.candidates(w):
        share = index.verify(w, t, s)
        if share > 0:
            added.add(index.labels[t])
            score = max(score, share)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | added)), score


def document_frequency(docs: DataFrame, words: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that hold each of the words; collected, as many rows as words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                counts.update(words.intersection(split_words(x)))
        keys = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[k] for k in keys], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Words, base phrases, labels and score of each row of docs."""
    vocabulary = frozenset(w for _, text, *_ in templates for w in split_words(text.encode()))
    index = Index(document_frequency(docs, vocabulary), templates)
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x, index) for x in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, {FIELDS}")
