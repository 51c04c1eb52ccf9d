from __future__ import annotations

import random

import pytest

from curvestat.llm import license_scan as L
from curvestat.llm.license_texts import TEMPLATES
from tests.llm.common import clashing, frame, prose


def test_base_and_added_labels(spark):
    rows = [
        (1, prose(1, 40) + " This work is licensed under the GNU General Public License, version 3. " + prose(2, 40), "en", "s", 0),
        (2, "Licensed under CC BY-NC 4.0. All rights reserved. CC BY", "en", "s", 0),
        (3, "the mit of version 2 license and public 3", "en", "s", 0),
        (4, "Released under the (improved) MIT License", "en", "s", 0),
        (5, None, None, None, None),
    ]
    got = {r["doc_id"]: r for r in L.scan_licenses(clashing(frame(spark, rows))).collect()}
    assert got[1]["base_labels"] == "gpl" and got[1]["labels"] == "gpl,gpl-3.0" and got[1]["first_word"] == got[1]["last_word"] == 47
    assert got[2]["base_labels"] == "cc-by,reserved" and got[2]["labels"] == "cc-by,cc-by-nc-4.0,reserved"
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["n_words"]) == (3, 2, 10, 12)
    assert got[3]["labels"] == "" and got[3]["score"] == 0.0
    assert got[4]["labels"] == "mit" and 0 < got[4]["score"] <= 1
    assert (got[5]["n_words"], got[5]["n_base"], got[5]["first_word"], got[5]["labels"]) == (0, 0, None, "")


def text_of(label):
    return next(text for name, text, *_ in TEMPLATES if name == label)


def altered(text, draw, share):
    """Words dropped, put in and replaced."""
    out = []
    for w in text.split():
        x = draw.random()
        if x < share / 3:
            continue
        out += [draw.choice(["qua", "lorem", "vel"])] if x < 2 * share / 3 else [w, "ipsum"] if x < share else [w]
    return " ".join(out)


def holds(phrase, window):
    """Whether a key phrase stands in the window: words joined by - side by side, between others one word at most."""
    parts = [L.split_words(p.encode()) for p in phrase.split()]

    def ends(k, at):
        if k == len(parts):
            return True
        n = len(parts[k])
        return any(window[s : s + n] == parts[k] and ends(k + 1, s + n) for s in ([at, at + 1] if k else range(len(window))))

    return ends(0, 0)


def brute(text, templates):
    """Labels by every template at every place, without anchors: most of its words and its key phrases in the window.

    The second set holds labels that every window with the most of the template's words gives; a window that
    cuts off a barred phrase gives a label only in the first.
    """
    w, every, best = L.split_words(text.encode()), {}, set()
    for label, body, groups, *barred in templates:
        words = L.split_words(body.encode())
        slack = L.SLACK + len(words) // L.DRIFT
        if sum(min(words.count(x), w.count(x)) for x in set(words)) < L.SHARE * len(words):
            continue  # no window holds more than the text
        met = lambda g: any(holds(p, window) for p in g.split("|"))  # noqa: E731, B023
        verdicts = []
        for s in range(-len(words), len(w)):
            window = w[max(0, s - slack) : max(0, s + len(words) + 2 * slack)]
            share = sum(min(words.count(x), window.count(x)) for x in set(words)) / len(words)
            if share >= L.SHARE:
                verdicts.append((share, all(map(met, groups)) and not any(map(met, barred))))
        right = [share for share, ok in verdicts if ok]
        if right:
            every[label] = max(every.get(label, 0), *right)
        top = max((share for share, _ in verdicts), default=0)
        if verdicts and all(ok for share, ok in verdicts if share == top):
            best.add(label)
    return every, best


@pytest.fixture(scope="module")
def index():
    draw = random.Random(4)
    return L.Index({w: draw.randint(0, 500) for _, text, *_ in TEMPLATES for w in L.split_words(text.encode())})


def test_scan_finds_what_every_place_gives(index):
    draw, met, missed = random.Random(5), 0, 0
    for i in range(0, 2 * len(TEMPLATES), 3):
        text = TEMPLATES[i % len(TEMPLATES)][1]
        whole = prose(i, 8) + " " + altered(text, draw, draw.choice([0.0, 0.1, 0.3])) + " " + prose(i + 500, 8)
        every, best = brute(whole, TEMPLATES)
        base = {L.BASE[p] for p in L.base_places(L.split_words(whole.encode()))}
        *_, labels, score = L.scan(whole.encode(), index)
        got = set(labels.split(",")) - {""}
        assert base <= got and got - base <= set(every) and score <= max([1.0 if base else 0.0, *every.values()]) + 1e-12
        met, missed = met + len(best), missed + len(best - got)
    assert met > 60 and missed <= 0.02 * met


@pytest.mark.parametrize("share, least, longer", [(0.0, 1.0, 1.0), (0.03, 0.94, 0.97), (0.1, 0.88, 0.9)])
def test_recall_on_altered_texts(index, share, least, longer):
    """Of all templates, and of those above eight words: a notice of three words whose name is altered names nothing."""
    draw, found = random.Random(6), []
    for i, (label, text, *_) in enumerate(TEMPLATES):
        for k in range(20):
            whole = prose(i + k, 30) + " " + altered(text, draw, share) + " " + prose(i + k + 500, 30)
            found.append((len(text.split()) > 8, label in L.scan(whole.encode(), index)[5].split(",")))
    long = [hit for is_long, hit in found if is_long]
    assert sum(hit for _, hit in found) >= least * len(found) and sum(long) >= longer * len(long)


def test_each_template_gets_its_own_label(index):
    kin = {"bsd", *L.BASE.values(), "lgpl", "agpl"}
    for label, text, *_ in TEMPLATES:
        labels = set(L.scan(text.encode(), index)[5].split(","))
        assert label in labels and labels <= {label} | kin, text


@pytest.mark.parametrize("text", [
    "the license of the software is not an apache version 2 0", "she was permitted to copy the gnu and any later version of it",
    "redistribution of wealth in source and in form", "a mit en of the cc on 4 0 license by nc", "permission to use any text with a fee is granted",
    "the license from MIT press", "general public opinion of version 3",
])
def test_what_is_no_licence(index, text):
    assert L.scan((prose(1, 40) + " " + text + " " + prose(2, 40)).encode(), index)[5] == ""


@pytest.mark.parametrize("text, label", [
    ("Redistributions of source code must retain the above copyright notice. " + text_of("bsd-3-clause"), "bsd-3-clause"),
    ("either version 3 of the License: " + text_of("gpl-3.0"), "gpl-3.0"),
    ("made available under the terms of the Eclipse Public License 2.0", "epl-2.0"),
    (text_of("mit").replace("AUTHORS", "CONTRIBUTORS").replace("Software", "Program"), "mit"),
    ("# " + text_of("apache-2.0").replace("\n", "\n# "), "apache-2.0"),
    ("// SPDX-License-Identifier: Apache-2.0\nint main;", "apache-2.0"),
    ("License: MIT", "mit"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "gpl-3.0"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License only. This program is distributed in the hope that it will be useful", "gpl-3.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License", "cc-by-3.0"),
])
def test_whole_licences_and_headers(spark, text, label):
    r = L.scan_licenses(frame(spark, [(1, prose(1, 50) + "\n" + text + "\n" + prose(2, 50), "en", "s", 0), (2, prose(3, 80), "en", "s", 0)])).orderBy("doc_id").collect()
    assert label in r[0]["labels"].split(",") and r[0]["score"] >= L.SHARE and r[1]["labels"] == ""


def test_overlapping_places():
    assert L.base_places(L.split_words(b"cc by cc by cc by")) == {"cc by": [0, 2, 4]}
    assert L.base_places(L.split_words("xcc by cc bye".encode())) == {}


def test_all_rows_and_empty_table(spark):
    assert L.scan_licenses(frame(spark)).count() == frame(spark).count()
    assert L.scan_licenses(frame(spark, [])).count() == 0
