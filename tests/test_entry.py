from __future__ import annotations

import os

import pytest


def test_contract(spark):
    import __spark_entry__ as entry

    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(names) > 80
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 1


def test_entry_works_without_the_corpus_modules(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_present", lambda module: False)
    assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert "pipeline" not in entry.oracle_sql()


def test_library_does_not_import_the_corpus_modules():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "curvestat")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert "curvestat.llm" not in text and "corpus_pipeline" not in text, f


@pytest.mark.parametrize("word", ["localCheckpoint"])
def test_forbidden_calls(word):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "curvestat")):
        for f in files:
            if f.endswith(".py"):
                assert word not in open(os.path.join(folder, f), encoding="utf-8").read()
