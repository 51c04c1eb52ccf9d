from __future__ import annotations

import hashlib

import pytest

from curvestat.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digest(rows):
    rows = [(r or "", t or "") for r, t in rows]
    loss = "".join(t for r, t in rows if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in rows)
    return len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "a\nb<", "<|<|\\", "\\n<|"])
def test_escapes_are_reversible(text):
    assert C.unescape(C.escape(text)) == text and C.END not in C.escape(text) and C.START not in C.escape(text)


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (1, 2, "user", None), (1, 3, "assistant", "<\\|ok é日"),
        (2, 5, "assistant", "only"), (3, 0, None, "no role"), (3, 1, "as\nsistant\\", "odd role"), (4, 0, "assistant", "b"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"),
        (None, 1, "user", "lost"), (None, 0, "assistant", "found"), (6, None, "user", "first"), (6, 0, "user", "second"),
    ]
    rows += [(7, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(700)]
    got = {r["conv_id"]: r for r in C.read_back(C.format_conversations(spark, spark.createDataFrame(rows, SCHEMA)), "conv_id").collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want[conv] = digest([(r[2], r[3]) for r in own])
    said = "<|im_end|><|im_start|>assistant ok"
    want[-1] = digest([("user", said), ("assistant", said)])
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == want


def test_formatted_text_and_parts(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(600)]
    parts = [r for r in C.format_conversations(spark, spark.createDataFrame(rows, SCHEMA)).filter("conv_id = 1").orderBy("part").collect()]
    assert [r["turns"] for r in parts] == [256, 256, 88]
    assert "".join(r["text"] for r in parts) == "".join(f"<|im_start|>{r[2]}\n{r[3]}<|im_end|>\n" for r in rows)
    learned = [r["text"][s["start"] : s["end"]] for r in parts for s in r["loss"]]
    assert learned == [f"t{i}" for i in range(1, 600, 2)]


def test_best_branches_of_a_tree(spark):
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 2, 0.0), ("t", 5, 3, 9.0), ("t", 6, 3, 9.0), ("u", 7, None, 0.0), ("v", 8, 99, 0.0)]
    nodes += [("w", 100 + i, 99 + i if i else None, float(i % 3)) for i in range(37)]
    df = spark.createDataFrame(nodes, "tree string, node int, parent int, score double")
    best = {(r["tree"], r["node"], r["depth"]) for r in C.paths(df).collect()}
    assert {x for x in best if x[0] in "tu"} == {("t", 1, 0), ("t", 3, 1), ("t", 5, 2), ("u", 7, 0)}
    assert {x for x in best if x[0] == "w"} == {("w", 100 + i, i) for i in range(37)}
    two = {(r["path"], r["node"]) for r in C.paths(df, 2).filter("tree = 't'").collect()}
    assert two == {(1, 1), (1, 3), (1, 5), (2, 1), (2, 3), (2, 6)}


def test_cycles_and_what_hangs_on_them_are_left_out(spark):
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("c", 10, 11, 0.0), ("c", 11, 10, 0.0), ("c", 12, 11, 5.0), ("s", 20, 20, 0.0), ("m", 30, None, 0.0), ("m", 31, 32, 9.0), ("m", 32, 31, 9.0), ("m", 33, 30, 0.0)]
    df = spark.createDataFrame(nodes, "tree string, node int, parent int, score double")
    assert {(r["node"], r["depth"]) for r in C.paths(df).collect()} == {(1, 0), (2, 1), (30, 0), (33, 1)}
    assert C.paths(df.filter("tree IN ('c', 's')")).count() == 0


def test_branches_are_formatted_in_the_order_of_their_scores(spark):
    """Two best paths of a tree, ranked and written as conversations of their own."""
    nodes = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "poor"), ("t", 3, 1, 8.0, "assistant", "good"), ("t", 4, 3, 8.0, "user", "more"), ("t", 5, 1, 3.0, "assistant", "fair")]
    df = spark.createDataFrame(nodes, "tree string, node int, parent int, score double, role string, text string")
    got = {r["path"]: r["text"] for r in C.parts(C.paths(df, 2), ["tree", "path"]).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {1: turn("user", "q") + turn("assistant", "good") + turn("user", "more"), 2: turn("user", "q") + turn("assistant", "fair")}


def test_an_input_conversation_of_the_probes_number(spark):
    got = C.read_back(C.format_conversations(spark, spark.createDataFrame([(-1, 0, "user", "mine")], SCHEMA)), "conv_id").collect()
    assert sorted((r["conv_id"], r["n_turns"]) for r in got) == [(-1, 1), (-1, 2)]


def test_empty_table(spark):
    got = C.read_back(C.format_conversations(spark, spark.createDataFrame([], SCHEMA)), "conv_id").collect()
    assert [r["conv_id"] for r in got] == [-1]
