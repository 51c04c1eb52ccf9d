"""Quality classifier: a support vector machine on Naive Bayes scaled n-gram indicators.

Features are indicators of n-grams in a whole text: byte trigrams (hashed),
4-grams of character shapes (16 classes, exact), and 4-grams of the pattern of
words equal to the word before. Each indicator is scaled by its class log-count
ratio; a linear model with hinge loss is fitted on the scaled indicators by
dual coordinate descent, with classes weighted evenly; margins become
probabilities by a logistic fit on a fifth of the rows kept out of the first fit.

Labels come only from rows whose crc32(doc_id as text) mod 3 is not 1. The
fit uses at most ``MAX_ROWS`` of them, those smallest by a hash of doc_id, and of these
only the first whose feature indices are ``MAX_FEATURES`` at most together, as they are
collected; of a repeated doc_id one text counts. Scoring is a narrow map over all documents.

Defined results: a null text counts as empty and is scored by the bias alone;
labels other than 0 and 1 are ignored, of a doc_id labelled twice the smallest label
counts; with no labels, or one class only, the score is (positives + 1) / (rows
+ 2) for all; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvestat.llm.common import cut

#: Bounds of the training sample: labelled documents, and the features of all of them together (4 bytes each on the driver).
MAX_ROWS = 4000
MAX_FEATURES = 25_000_000
TRIGRAM_BITS = 18
ALPHA = 1.0
COST = 0.05
EPOCHS = 12
SEED = 6
#: Bytes of each shape class above 5 (below: other, upper, lower, digit, high byte, space).
SHAPES = ("\n", ".,;:", "!", "?", "#*$%&", "|<>", "'\"`", "()[]{}", "-_/\\", "@+=~^")

_TRIGRAMS = 1 << TRIGRAM_BITS
_SHAPE_AT = _TRIGRAMS
_SAME_AT = _SHAPE_AT + (1 << 16)
SIZE = _SAME_AT + 16


def shape_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("a") : ord("z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[128:] = 4
    table[[9, 11, 12, 13, 32]] = 5
    for i, chars in enumerate(SHAPES):
        table[[ord(c) for c in chars]] = 6 + i
    return table


class Features:
    """Distinct feature indices of a text."""

    def __init__(self) -> None:
        self.table = shape_table()
        self.mark = np.zeros(SIZE, dtype=np.int64)

    def __call__(self, text: bytes | None) -> np.ndarray:
        data = text or b""
        raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        parts = []
        if len(raw) >= 3:
            h = raw[:-2] * 0x10001 + raw[1:-1] * 0x1003F + raw[2:] * 0x9E35
            parts.append((h * 0x9E3779B1 >> 13) & (_TRIGRAMS - 1))
        if len(raw) >= 4:
            s = self.table[raw]
            parts.append(_SHAPE_AT + (s[:-3] << 12 | s[1:-2] << 8 | s[2:-1] << 4 | s[3:]))
        w = data.split()
        if len(w) >= 5:
            e = np.fromiter((a == b for a, b in zip(w, w[1:], strict=False)), dtype=np.int64, count=len(w) - 1)
            parts.append(_SAME_AT + (e[:-3] << 3 | e[1:-2] << 2 | e[2:-1] << 1 | e[3:]))
        if not parts:
            return np.empty(0, dtype=np.int64)
        index = np.concatenate(parts)
        order = np.arange(len(index))
        self.mark[index] = order
        return index[self.mark[index] == order]


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Class log-count ratio of each feature."""
    counts = np.full((2, SIZE), ALPHA)
    for x, label in zip(rows, y, strict=True):
        counts[int(label), x] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights (of the indicators, so with r multiplied in) and bias, by dual coordinate descent."""
    sign = np.where(y > 0, 1.0, -1.0)
    upper = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y <= 0).sum()))) * cost
    values = [r[x] for x in rows]
    norm = np.array([v @ v + 1.0 for v in values])
    w, bias, dual = np.zeros(SIZE), 0.0, np.zeros(len(y))
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(y)):
            x, v = rows[i], values[i]
            slope = sign[i] * (w[x] @ v + bias) - 1.0
            new = min(max(dual[i] - slope / norm[i], 0.0), upper[i])
            if new != dual[i]:
                change = (new - dual[i]) * sign[i]
                w[x] += change * v
                bias += change
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-4 * cost:
            break
    return w * r, bias


def fit_logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through margins, by Newton steps with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([(p - goal) @ margin, (p - goal).sum()]) + np.array([1e-3 * a, 0])
        v = p * (1 - p) + 1e-9
        h = np.array([[v @ margin**2 + 1e-3, v @ margin], [v @ margin, v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


class Model:
    """Probability of label 1 from distinct feature indices."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        self.constant = None
        if len(y) == 0 or y.min() == y.max():
            self.constant = (float(y.sum()) + 1) / (len(y) + 2)
            return
        apart = np.arange(len(y)) % 5 == 4
        if len({*y[apart]}) == 2 and len({*y[~apart]}) == 2:
            some = [x for x, out in zip(rows, apart, strict=True) if not out]
            w, bias = fit_hinge(some, y[~apart], ratios(some, y[~apart]))
            margins = np.array([w[x].sum() + bias for x, out in zip(rows, apart, strict=True) if out])
            self.slope, self.shift = fit_logistic(margins, y[apart])
        else:
            self.slope, self.shift = 1.0, 0.0
        w, self.bias = fit_hinge(rows, y, ratios(rows, y))
        self.weights = w.astype(np.float32)

    def score(self, x: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        margin = float(self.weights[x].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))


def third(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS, most_features: int = MAX_FEATURES) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature indices and labels of the bounded training sample."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (third(F.col("doc_id")) != 1))
    place = F.xxhash64(F.lit(SEED), "doc_id")
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("place", place).orderBy("place", "doc_id").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    # one text of each doc_id, the one of the smallest hash, so that repeated rows count once
    first = rows.select("doc_id", F.xxhash64("text").alias("tie")).groupBy(F.col("doc_id").alias("f_id")).agg(F.min("tie").alias("f_tie"))
    joined = rows.join(F.broadcast(first), (F.col("doc_id") == F.col("f_id")) & (F.xxhash64("text") == F.col("f_tie"))).select("doc_id", "place", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, seen = Features(), set()
        for batch in batches:
            new = []  # of equal rows a task makes one; those of several tasks meet below
            for i, (place_, key) in enumerate(zip(batch.column(1).to_pylist(), batch.column(0).cast(pa.string()).to_pylist(), strict=True)):
                if (place_, key) not in seen:
                    seen.add((place_, key))
                    new.append(i)
            own = batch.take(pa.array(new, pa.int64()))
            rows = [features(x).astype(np.int32) for x in own.column(3).to_pylist()]
            sizes = pa.array([len(x) for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.string()), own.column(1), own.column(2).cast(pa.int32()), sizes, pa.array([x.tobytes() for x in rows], pa.binary())], names=["doc_id", "place", "quality", "n", "x"])

    made = cut(joined.mapInArrow(run, "doc_id string, place bigint, quality int, n bigint, x binary"))
    single = made.groupBy("doc_id", "place", "quality", "n").agg(F.min("x").alias("x"))
    sizes = sorted((r["place"], r["doc_id"], r["n"]) for r in made.select("doc_id", "place", "n").distinct().collect())
    sums = np.cumsum([n for _, _, n in sizes])
    kept = int(np.searchsorted(sums, most_features, "right"))
    if kept < len(sizes):
        single = single.filter(F.struct("place", "doc_id") <= F.struct(F.lit(sizes[kept - 1][0]), F.lit(sizes[kept - 1][1]))) if kept else single.limit(0)
    found = single.collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return [np.frombuffer(r["x"], dtype=np.int32).astype(np.int64) for r in found], np.array([r["quality"] for r in found], dtype=np.float64)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model = Model(*training_rows(docs, labels, most))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            scores = [model.score(features(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(third(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
