from __future__ import annotations

import random

import pytest

from curvestat.llm import decontamination as D
from tests.llm.common import clashing, documents, frame, prose


def fewest(body, region):
    """Edits of body against any part of region, by the whole matrix."""
    previous = [0] * (len(region) + 1)
    for i, c in enumerate(body, 1):
        current = [i]
        for j, e in enumerate(region, 1):
            current.append(min(previous[j - 1] + (c != e), previous[j] + 1, current[j - 1] + 1))
        previous = current
    return min(previous)


def edited(text, edits, draw):
    s = list(text)
    for _ in range(edits):
        p, kind = draw.randrange(len(s)), draw.random()
        if kind < 0.4:
            s[p] = draw.choice("abcdefgh ")
        elif kind < 0.7:
            s.insert(p, draw.choice("xyz"))
        else:
            del s[p]
    return "".join(s)


@pytest.mark.parametrize(("seed", "least", "most"), [(0, 5, 30), (1, 5, 30), (2, 5, 30), (3, 1, 4), (4, 1, 6), (5, 1, 4)])
def test_hits_match_brute_force(seed, least, most):
    """All windows of all items against whole texts; the later seeds have items of 5 to 40 characters."""
    draw = random.Random(seed)
    items = [(i, prose(900 + 10 * seed + i, draw.randint(least, most))) for i in range(8)]
    index = D.Index(items)
    found = edits_found = 0
    for _ in range(25):
        chosen = draw.randrange(len(items))
        body = D.normalise(items[chosen][1])
        passage = edited(body, min(len(body) - 1, draw.randint(0, 9 if most > 6 else 2)), draw)
        text = D.padded(prose(draw.randrange(100), 40) + " " + passage + " " + prose(draw.randrange(100), 40))
        want = {}
        for item, body, k in index.windows():
            edits = fewest(body, text)
            if edits <= k:
                want[item] = min(edits, want.get(item, 99))
        got = index.hits(text)
        assert {i: h[0] for i, h in got.items()} == want
        assert all(0 <= s < e <= len(text) - 2 for _, s, e in got.values())
        found += bool(want)
        edits_found += any(want.values())
    assert found >= 10 and edits_found >= 3


@pytest.mark.parametrize(("piece", "expanded"), [(1, 1), (40, 200), (300, 10**6)])
def test_hits_do_not_depend_on_pieces(monkeypatch, piece, expanded):
    """Items that share phrases, against texts that repeat them, whole and with edits."""
    draw = random.Random(9)
    phrases = [D.normalise(prose(70 + i, n)) for i, n in enumerate((8, 14, 30))]
    items = [(i, phrases[i % 3] + " " + prose(500 + i, draw.randint(5, 30))) for i in range(12)] + [(12, "aaaa " * 40)]
    texts = [D.padded(" ".join(draw.choice([*phrases, edited(items[draw.randrange(12)][1], draw.randint(0, 6), draw), prose(draw.randrange(99), 12), "aaaa " * 50]) for _ in range(9))) for _ in range(12)]
    whole = D.Index(items)
    want = [{i: h[0] for i, h in whole.hits(t).items()} for t in texts]
    brute = [{} for _ in texts]
    for n, t in enumerate(texts[:3]):
        for item, body, k in whole.windows():
            if (e := fewest(body, t)) <= k:
                brute[n][item] = min(e, brute[n].get(item, 99))
    assert want[:3] == brute[:3] and sum(map(len, want)) > 20
    monkeypatch.setattr(D, "PIECE", piece)
    monkeypatch.setattr(D, "EXPANDED", expanded)
    assert [{i: h[0] for i, h in whole.hits(t).items()} for t in texts] == want


def test_shared_phrasing_in_bounded_memory():
    """2,000 items that begin with the same 200 characters, and a page of a million that repeats them."""
    import time
    import tracemalloc

    phrase = D.normalise(prose(31, 60))[:200]
    index = D.Index([(i, phrase + " " + prose(10_000 + i, 20)) for i in range(2000)])
    page = D.padded(" ".join([phrase] * 5000))
    began = time.perf_counter()
    tracemalloc.start()
    found = index.hits(page)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2000 and all(h[0] == 0 for h in found.values())
    assert most < 1e9 and time.perf_counter() - began < 40


def test_filter_of_large_benchmarks_lets_few_clean_texts_pass(spark, monkeypatch):
    """At the density of a bitmap that follows the number of q-grams, and for many short items, by hashes."""
    draw = random.Random(4)
    letters = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    clean = [D.padded(letters(n)) for n in (3000, 60_000) for _ in range(20)]
    short = spark.createDataFrame([(i, letters(20)) for i in range(10_000)], "item_id bigint, text string")
    kinds = D.shared_filter(short)
    assert all(k[3] for k in kinds) and sum(D.suspicious(t, kinds) for t in clean) <= 2
    items = [(i, letters(500)) for i in range(400)]
    monkeypatch.setattr(D, "MOST_EXACT", 1000)
    kinds = D.shared_filter(spark.createDataFrame(items, "item_id bigint, text string"))
    assert not any(k[3] for k in kinds) and sum(D.suspicious(t, kinds) for t in clean) <= 2
    assert all(D.suspicious(D.padded(letters(900) + " " + text[100:190] + " " + letters(50)), kinds) for _, text in items[:40])


def test_short_items_are_found_with_an_edit():
    """A bound of 1 at least for every length: q gets smaller where the edits ask for it."""
    for size in range(3, 120):
        m, k, q, need = D.shape(size)
        assert q >= 1 and need >= 1 and (q == D.Q or k == 0 or need <= k + 1)
    for text in ("answers the old riddle well", "fourteen chars"):
        index = D.Index([(1, text)])
        changed = text[:6] + "#x" + text[8:] if len(text) > 26 else text[:6] + "x" + text[7:]
        assert index.hits(D.padded(f"it is said that {changed} by all"))[0][0] >= 1
        assert not index.hits(D.padded(f"it is said that {text[: len(text) // 2]} by all"))


@pytest.mark.parametrize("step", range(0, 60, 7))
def test_every_passage_of_ninety_characters_is_found(step):
    body = D.normalise(prose(5151, 60))
    assert D.Index([(1, body)]).hits(D.padded(f"before that {body[100 + step : 190 + step]} after it"))


def test_alignment_in_a_band():
    draw = random.Random(5)
    for _ in range(200):
        body = "".join(draw.choice("abcd") for _ in range(draw.randint(20, 60)))
        region = "".join(draw.choice("abcd") for _ in range(draw.randint(0, 9))) + edited(body, draw.randint(0, 7), draw) + "".join(draw.choice("abcd") for _ in range(draw.randint(0, 9)))
        assert D.align(body, region, 5)[0] == min(6, fewest(body, region))


def test_long_texts_are_cut_in_slices(monkeypatch):
    monkeypatch.setattr(D, "SLICE", 300)
    item = prose(4242, 30)
    index = D.Index([(1, item)])
    for at in (0, 17, 40, 61, 300):
        text = D.padded((prose(1, at) if at else "") + " " + item + " " + prose(2, 200))
        assert index.hits(text)[0][0] == 0


@pytest.mark.parametrize("most", [D.INDEX_CHARS, 100])
def test_table(spark, most):
    """One block, and several with the corpus scanned once against the shared bitmap."""
    items = [(1, prose(4000, 25)), (2, prose(4001, 60)), (3, None), (4, ""), (5, "short item")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = documents() + [
        (600, prose(1, 50) + "\n" + items[0][1].upper() + "\n" + prose(2, 50), "en", "s", 0),
        (601, prose(3, 50) + " " + items[1][1][:200] + " " + prose(4, 20), "en", "s", 0),
        (602, "a SHORT, item here", "en", "s", 0),
        (603, "shortitem here", "en", "s", 0),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(spark, clashing(frame(spark, rows)), bench, most).collect()}
    assert got == {(600, 1), (601, 2), (602, 5)}
    kept = D.drop_contaminated(spark, clashing(frame(spark, rows)), bench, most)
    assert kept.columns == clashing(frame(spark, rows)).columns and kept.count() == len(rows) - 3
    assert D.contaminated(spark, frame(spark, []), bench).count() == 0
    assert D.contaminated(spark, frame(spark, rows), bench.limit(0)).count() == 0


def test_blocks_hold_every_item_once(spark):
    bench = spark.createDataFrame([(i, prose(i, 20)) for i in range(30)], "item_id bigint, text string")
    parts = list(D.blocks(bench, 500))
    assert len(parts) > 3 and sorted(i for p in parts for i, _ in p) == list(range(30))
