from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from curvestat.llm import token_counts as T
from tests.llm.common import clashing, documents, frame

PATH = public_tokenizers.path(T.MODEL)
LETTERS = ["a", "b", " ", "  ", "\n", "▁", "é", "日本", "<s>", "</s>", "\t", "the ", " x", "qz", "\x00", "ﬁ", "😀", "　", "looooong"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 4), (9, 1), (300, 30)])
def test_spliced_counts_equal_the_library(library, chunk, overlap):
    counter, draw = T.Counter(PATH, chunk, overlap), random.Random(chunk)
    for _ in range(800):
        text = "".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 150)))
        assert counter.count(text) == len(library.encode(text)), repr(text)
    assert counter.count("a" * 500) == len(library.encode("a" * 500))
    assert counter.splices and counter.widened and counter.replaced


class Hasty(T.Counter):
    """Takes any shared boundary for a stable one."""

    def stable(self, data, at):
        return T.begins(data, at)


def test_boundaries_that_are_only_shared_give_wrong_counts(library):
    """Splices matter: without the proof, and without widening, counts differ from the library's."""
    draw = random.Random(1)
    texts = ["".join(draw.choice(["aaaa", "looooo", "ing", "tion", "abab", "the"]) for _ in range(60)) for _ in range(200)]
    exact, hasty = T.Counter(PATH, 60, 4), Hasty(PATH, 60, 4)
    truth = [len(library.encode(x)) for x in texts]
    assert [exact.count(x) for x in texts] == truth
    assert sum(hasty.count(x) != n for x, n in zip(texts, truth, strict=True)) >= 1
    assert sum(sum(len(exact.encode(d, i, min(i + 60, len(d)))) - 1 for i in range(0, len(d), 60)) != n for d, n in ((("▁" + x).encode(), n) for x, n in zip(texts, truth, strict=True))) >= 100


def test_offsets_are_those_of_the_library(library):
    counter = T.Counter(PATH)
    text = "Some words,  été 日本語\n<s> 😀 and more"
    data = (T.SPACE + text.replace(" ", T.SPACE)).encode()
    at = counter.encode(data, 0, len(data))
    pieces = library.encode(text, out_type=str)
    assert at[-1] == len(data) and len(at) == len(pieces) + 1
    for p, (a, b) in zip(pieces, zip(at, at[1:], strict=False), strict=True):
        assert data[a:b] == (bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.encode())


def test_long_text_without_spaces_is_linear(library):
    draw = np.random.default_rng(2)
    han = "".join(map(chr, draw.integers(0x4E00, 0x5E00, 200_000)))
    counter, times = T.Counter(PATH), []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        assert counter.count(han[:n]) == len(library.encode(han[:n]))
        times.append(time.perf_counter() - began)
    assert counter.splices >= 10 and not counter.replaced and times[1] < 12 * times[0]
    # no pair of these letters is outside the vocabulary: one stretch, encoded whole
    assert counter.count("a" * 200_000) == len(library.encode("a" * 200_000)) and counter.replaced <= 4


def test_whole_table(spark, library):
    rows = documents()
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in T.count_tokens(clashing(frame(spark)), PATH, chunk=5000).collect())
    n = lambda t: len(library.encode(t or ""))
    assert got == sorted((r[0] is None, r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > T.LIMIT) for r in rows)
    assert T.count_tokens(frame(spark, []), PATH).count() == 0
