"""Small document tables with awkward rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ou"]
    out = []
    for i in range(words):
        w = "".join(draw.choice(parts) for _ in range(draw.randint(1, 4)))
        out.append(w.capitalize() if i % 9 == 0 else w)
        if i % 9 == 8:
            out[-1] += ".\n" if draw.random() < 0.4 else "."
    return " ".join(out).replace("\n ", "\n")


def documents(n: int = 40) -> list[tuple]:
    rows = [(i, prose(i, 30 + 5 * i), "en", f"src{i % 4}", 0) for i in range(n)]
    rows += [
        (100, None, None, None, None),
        (101, "", "en", "src1", 0),
        (102, " \n\t ", "en", None, 0),
        (103, "word", "en", "src1", 4),
        (104, "two words", "en", "src1", 9),
        (105, rows[3][1], "en", "src2", 0),
        (106, rows[3][1].upper(), "en", "src3", 0),
        (107, rows[5][1] + " extra", "fr", "src1", 0),
        (None, "a row without an identifier " * 5, "en", "src1", 0),
        rows[7],
        rows[7],
        (108, prose(999, 30000), "en", "src0", 0),
        (109, "日本語 テスト " * 20, "ja", "src2", 0),
    ]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d, _ in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def clashing(df):
    """Extra columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    names = ["fp", "size", "h", "w", "lines", "host", "row_key", "rejected_key", "mix_key", "mix_copy", "shard", "slot", "shard_key", "chosen_id", "n_words", "key", "target", "found", "taken", "label", "tie", "part", "x"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
