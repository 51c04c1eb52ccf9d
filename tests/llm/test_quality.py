from __future__ import annotations

import re
from collections import Counter, defaultdict

from curvestat.llm import quality_rules as Q
from tests.llm.common import clashing, documents, frame, prose


def brute(rows, min_texts, share, min_left):
    texts = defaultdict(set)
    held = defaultdict(set)
    split = lambda t: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    for _, text, _, source, _ in rows:
        texts[source].add(text)
        for line in split(text):
            held[source, norm(line)].add(text)
    out = []
    for doc_id, text, _, source, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(tri)
        covered = {i + k for i, g in enumerate(tri) if n[g] > 1 for k in range(3)}
        lines = split(text)
        gone = sum(len(norm(x).split(" ")) for x in lines if len(held[source, norm(x)]) > max(min_texts, share * len(texts[source])))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed, not failed and len(w) - gone >= min_left * len(w)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_report_matches_brute_force(spark):
    banner = " ".join(f"Banner{i}" for i in range(60))
    rows = documents()
    rows += [(200 + i, prose(500 + i, 55 + 60 * (i % 2)) + "\n  " + banner.upper() + " \n" + banner, "en", "many", 0) for i in range(15)]
    rows += [(300, "x y z " * 100, "en", "many", 0), (301, "#*$ " * 60, "en", None, 0), (302, banner + "\n" + prose(77, 80), "en", "few", 0)]
    got = sorted((tuple(r) for r in Q.report(clashing(frame(spark, rows))).collect()), key=key)
    want = sorted(brute(rows, Q.MIN_TEXTS, Q.SHARE, Q.MIN_LEFT), key=key)
    assert got == want
    verdict = {r[0]: r[-1] for r in got}
    assert not verdict[200] and not verdict[201] and verdict[302]


def test_many_boilerplate_lines_are_found_without_a_broadcast(spark, monkeypatch):
    shared = [" ".join(f"line{k}word{i}" for i in range(6)) for k in range(5)]
    rows = [(i, prose(900 + i, 120) + "\n" + shared[i % 5] + "\n" + shared[(i + 1) % 5], "en", "src", 0) for i in range(40)]
    want = sorted(map(tuple, Q.keep_clean(frame(spark, rows)).collect()))
    assert len(want) == 40 and not any("line0word0" in r[1] for r in want)
    monkeypatch.setattr(Q, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, Q.keep_clean(frame(spark, rows)).collect())) == want


def test_a_share_of_the_host(spark):
    """A share of the host's texts may be asked for besides: then a line of 12 of 100 texts stays below a fifth."""
    line = " ".join(f"shared{i}" for i in range(30))
    rows = [(i, prose(3000 + i, 90) + (f"\n{line}" if i < 12 else ""), "en", "big", 0) for i in range(100)]
    assert Q.keep_clean(frame(spark, rows), share=0.2).count() == 100


def test_keep_clean(spark):
    kept = Q.keep_clean(clashing(frame(spark)))
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert kept.columns == clashing(frame(spark)).columns and ids.count(7) == 3 and 100 not in ids and 101 not in ids and {10, 20, 108} <= set(ids)


def test_empty_table(spark):
    assert Q.report(frame(spark, [])).count() == 0 and Q.keep_clean(frame(spark, [])).count() == 0


def test_keep_clean_removes_boilerplate_lines(spark):
    line = "Shared  line of the\tsource"
    rows = [(i, f"{line.upper() if i % 2 else line}\n\n{prose(4000 + i, 90)}\n {line}", "en", "many", 7) for i in range(12)] + [(50, prose(4050, 90) + "\n" + line, "en", "few", 7)]
    rows += [rows[3]]
    want = sorted((i, t if s == "few" else "\n" + t.split("\n", 1)[1][1:].rsplit("\n", 1)[0], s) for i, t, _, s, _ in rows)
    got = Q.keep_clean(frame(spark, rows), share=0.0).collect()
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in got) == want
    assert all(r["n_chars"] == (7 if r["source"] == "few" else len(r["text"])) for r in got)
    assert {r["kept"] for r in Q.report(frame(spark, rows)).collect()} == {True}
