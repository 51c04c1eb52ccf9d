from __future__ import annotations

import zlib

import numpy as np

from curvestat.llm import quality_classifier as Q
from tests.llm.common import clashing, documents, frame, prose

LABELS = "doc_id bigint, quality int, toxic int"


def corpus():
    rows = [(i, prose(i, 40) if i % 2 else " ".join(w + "$$$" for w in prose(i, 40).split()), "en", "s", 0) for i in range(240)]
    labels = [(i, i % 2, 0) for i in range(240)]
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    got = Q.classify(spark, clashing(frame(spark, rows)), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_held_out_labels_are_never_used(spark):
    rows, labels = corpus()
    swapped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    score = lambda ls: {r["doc_id"]: r["score"] for r in Q.classify(spark, frame(spark, rows), spark.createDataFrame(ls, LABELS)).collect()}
    assert score(labels) == score(swapped)


def test_the_sample_is_bounded_by_documents_and_features(spark):
    """A labelled document of 100,000 equal rows counts once, and features are bounded whatever the texts."""
    rows, labels = corpus()
    docs = frame(spark, rows).unionByName(spark.range(100_000).selectExpr("2L AS doc_id", "'many equal rows' AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars"))
    x, y = Q.training_rows(docs, spark.createDataFrame(labels, LABELS))
    assert len(x) == len(y) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(240))
    few, _ = Q.training_rows(docs, spark.createDataFrame(labels, LABELS), 4000, 5000)
    assert 0 < sum(map(len, few)) <= 5000 and len(few) < len(x)
    assert len(Q.training_rows(docs, spark.createDataFrame(labels, LABELS), 17)[0]) == 17


def test_awkward_rows(spark):
    odd = [(0, 1, 0), (0, 0, 0), (None, 1, 0), (3, None, 0), (5, 7, None), (999, 1, 0)]
    got = Q.classify(spark, frame(spark), spark.createDataFrame(odd, LABELS)).collect()
    assert len(got) == len(documents()) and len({r["score"] for r in got}) == 1
    got = Q.classify(spark, frame(spark), spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in got} == {0.5}
    assert Q.classify(spark, frame(spark, []), spark.createDataFrame(odd, LABELS)).count() == 0


def test_descent_separates_and_features_are_distinct():
    rng = np.random.default_rng(0)
    y = np.array([0, 1] * 30, dtype=float)
    rows = [np.unique(np.r_[rng.integers(100, 200, 5), 1 if label else 2]) for label in y]
    w, bias = Q.fit_hinge(rows, y, Q.ratios(rows, y), cost=1.0)
    assert all((w[x].sum() + bias > 0) == bool(label) for x, label in zip(rows, y, strict=True))
    index = Q.Features()(b"abc abc abc abc abc abc")
    assert len(index) == len(set(index)) and len(Q.Features()(None)) == 0
