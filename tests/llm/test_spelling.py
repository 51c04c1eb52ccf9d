from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from curvestat.llm import spelling_variants as V
from tests.llm.common import clashing, documents, frame

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def distance_is_one(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows) -> set[tuple]:
    counts: Counter = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and distance_is_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


def got(df) -> list[tuple]:
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return [tuple(r) for r in df.collect()]


def corpus() -> list[tuple]:
    """Words at one and two edits of each other, chains of forms, letters above ASCII, runs of equal letters."""
    draw = random.Random(5)
    words = ["variance", "éclairés", "aaaaaaaaa", "aaaaaaaa", "aaaaaaab", "abababab", "babababa", "Straße×÷", "ÀÉÎÕÜÿÿ", "measurement"]
    rows = []
    for i, w in enumerate(words):
        x = w
        for level, times in enumerate((300, 25, 2)):
            if level:
                at = draw.randrange(len(x))
                x = draw.choice([x[:at] + x[at + 1 :], x[:at] + "z" + x[at:], x[:at] + "q" + x[at + 1 :]])
            rows += [(100 * i + level, f"{x}, {x.upper() if x.isascii() else x}. " * (times // 2), "en", "s", 0)]
    return rows


def test_against_brute_force(spark):
    rows = corpus() + documents(12)
    want = brute(rows)
    out = got(V.variants(frame(spark, rows)))
    assert len(out) == len(set(out)) and set(out) == want
    assert sum(w[1] is not None for w in want) > 5 and any(w[2] != w[1] and w[1] is not None for w in want)


def test_noise_deletes_within_words():
    assert V.noisy(b"a", 0) in (b"a", b"")
    seen = {V.noisy("é".encode() * 9, crc32(b"%d:" % i)) for i in range(400)}
    assert seen == {"é".encode() * 9, "é".encode() * 8}


def test_long_words_are_whole(spark):
    """Runs of 40,000 letters that differ in one place, and one with a letter more, are near words."""
    draw = random.Random(2)
    base = "".join(draw.choice("abcdefgh") for _ in range(40_000))
    other = base[:20_000] + ("x" if base[20_000] != "x" else "y") + base[20_001:]
    rows = [(i, f"{w} {w}", "en", "s", 0) for i, w in enumerate((base, other, base + "k", base[5:]))]
    # three documents that the noise leaves alone
    rows = [(next(d for d in range(i * 1000, i * 1000 + 999) if crc32(f"{d}:{r[1].split()[0]}".encode()) % 31), *r[1:]) for i, r in enumerate(rows)]
    out = {len(w) if w != other else "other": n_near for w, _, _, _, n_near, _ in got(V.variants(frame(spark, rows)))}
    assert out == {40_000: 2, "other": 1, 40_001: 1, 39_995: 0}


def test_keys_do_not_depend_on_blocks(monkeypatch):
    words = [w.encode("latin-1") for w in ("variances", "aabbccdd", "éééééééé", "abcdefgh")]
    together = V.deletions(words)
    single = [V.deletions([w]) for w in words]
    for i in (1, 3, 4):
        assert together[i].tolist() == np.concatenate([s[i] for s in single]).tolist()
    assert len(together[3]) == sum(len({w[:i] + w[i + 1 :] for i in range(len(w))}) for w in words)


def test_verification_does_not_trust_keys(spark, monkeypatch):
    """With keys that collide, words further apart meet but aren't near."""
    rows = [(1, "abcdefgh abcdefgh stuvwxyz stuvwxyz", "en", "s", 0)]
    real = V.emitted
    monkeypatch.setattr(V, "emitted", lambda words: real(words).selectExpr("kind", "0L AS key", "h1", "h2"))
    assert {r[4] for r in got(V.variants(frame(spark, rows)))} == {0}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, "", "en", "s", 0)], [(1, "short words no one", "en", "s", 0)]])
def test_tables_without_words(spark, rows):
    assert got(V.variants(frame(spark, rows))) == []


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(None, "Repeated words repeated", "en", "s", 0)] * 3 + [(7, "repeatid", None, None, None)] * 2
    df = clashing(frame(spark, rows)).selectExpr("*", "1 AS h1", "2 AS kind", "3 AS word", "4 AS n")
    assert set(got(V.variants(df))) == brute(rows)


def test_partial_counts(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    monkeypatch.setattr(V, "HELD", 3)
    assert set(got(V.variants(frame(spark, rows)))) == want
