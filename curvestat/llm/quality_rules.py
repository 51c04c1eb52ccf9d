"""Quality rules: rule features of each text and cross-document line frequency.

Lines are normalised (ASCII and Unicode lower case, white space runs to one
space, trimmed) and hashed. A line's frequency is the number of distinct texts
of its host (the ``source`` column) that hold it, so exact copies of one
document count once. A line is boilerplate when that number is above
``max(min_texts, share * distinct texts of the host)``; a document is depleted,
and rejected, when fewer than ``min_left`` of its words remain without its
boilerplate lines. ``report`` gives verdicts; ``keep_clean`` gives the kept rows
with these lines removed from their texts, other lines as they are.

Defined results: a null text counts as empty; a null host is a host of its own;
lines without a word are ignored; repeated rows get the same verdict each; an
empty table gives an empty result; other columns of the input are ignored.

Scale: the text is read once into one narrow row per document (features and
line hashes), checkpointed. Frequencies are counted in two steps keyed by
(host, line, text) and then (host, line), both partially aggregated, so a line
held by a third of all documents is never gathered in one task. The
boilerplate lines are counted and broadcast where they are few; more are replicated over
``SALTS`` salts and joined by (host, line, salt), which spreads a hot line's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvestat.llm.common import BLANKS, cut, few, fresh, let, words

#: A line in more distinct texts of its host than this, and than SHARE of them, is boilerplate.
#: With a share of 0 the limit is the same however large a host is.
MIN_TEXTS = 10
SHARE = 0.0
#: A document keeps at least this share of its words after boilerplate lines go.
MIN_LEFT = 0.8
#: Boilerplate lines, and verdicts, up to which they are broadcast.
MOST_BROADCAST = 100_000
MIN_WORDS = 50
SALTS = 64
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def _normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), BLANKS, " "))


def _windows(w: Column) -> Column:
    return F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated(h: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in the array h."""

    def covered(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))
        zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
        step = lambda acc, p: F.struct(
            (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"), (p + WINDOW).alias("end")
        )
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("p"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(pairs, covered))


def features(docs: DataFrame) -> DataFrame:
    """One row per document: rule features, and hash and word count of each normalised line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        F.col("doc_id"),
        F.col("source").alias("host"),
        text.alias("text"),
        words(text).alias("w"),
        lines.alias("lines"),
        F.xxhash64(F.col("text")).alias("text_hash"),
    )
    second = first.select(
        "doc_id",
        "host",
        "text_hash",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _windows(F.col("w")).alias("h"),
        F.transform(
            "lines",
            lambda x: let(
                _normalised(x),
                lambda y: F.struct(F.xxhash64(y).alias("line"), F.size(F.split(y, " ")).alias("n")),
            ),
        ).alias("lines"),
    )
    third = second.withColumn("n_repeat_words", _repeated(F.col("h"))).drop("h")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return third.withColumn("base_failed", failed)


def verdicts(docs: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """Features, base_failed, gone (hashes of the boilerplate lines; null: none), words removed with them, and kept, for each row of docs."""
    base = cut(features(docs))
    line = base.select("host", "text_hash", F.explode("lines").alias("l")).select("host", "text_hash", "l.line")
    held = line.groupBy("host", "line", "text_hash").agg(F.lit(1).alias("x")).groupBy("host", "line").agg(F.count("*").alias("held")).filter(F.col("held") > min_texts)
    if share > 0:
        texts = base.groupBy("host", "text_hash").agg(F.lit(1).alias("x")).groupBy(F.col("host").alias("limit_host")).agg(F.count("*").alias("texts"))
        held = held.join(texts, F.col("host").eqNullSafe(F.col("limit_host"))).filter(F.col("held") > share * F.col("texts"))
    boilerplate = cut(held.select(F.col("host").alias("b_host"), F.col("line").alias("b_line")))
    key = F.xxhash64("doc_id", "host", "text_hash")
    placed = base.select(key.alias("row_key"), "host", F.posexplode("lines").alias("at", "l")).select("row_key", "host", "at", "l.line", "l.n")
    same = F.col("host").eqNullSafe(F.col("b_host")) & (F.col("line") == F.col("b_line"))
    if boilerplate.count() <= MOST_BROADCAST:  # lines needn't be shuffled to find these
        met = placed.join(F.broadcast(boilerplate), same, "left_semi")
    else:
        salted = boilerplate.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("row_key", "at"), F.lit(SALTS)).cast("int")
        met = placed.withColumn("salt", salt).join(salted, same & (F.col("salt") == F.col("b_salt")), "left_semi")
    removed = (
        met.groupBy("row_key")
        .agg(F.collect_set(F.struct("at", "n", "line")).alias("gone"))
        .select("row_key", F.array_distinct("gone.line").alias("gone"), F.aggregate("gone", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]).alias("removed"))
    )
    left = base.drop("lines").withColumn("row_key", key).join(removed, "row_key", "left").withColumn("removed", F.coalesce("removed", F.lit(0).cast("bigint")))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("removed") >= min_left * F.col("n_words"))
    return left.withColumn("kept", kept)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def report(docs: DataFrame) -> DataFrame:
    return verdicts(docs).select(*COLUMNS)


def keep_clean(docs: DataFrame, min_texts: int = MIN_TEXTS, share: float = SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The rows of docs whose verdict is kept, without boilerplate lines, with the columns of docs.

    Where lines go, n_chars becomes the length of what is left.
    """
    key, other, gone = fresh(docs, "row_key", "rejected_key", "gone_lines")
    found = verdicts(docs, min_texts, share, min_left).filter(~F.col("kept") | F.col("gone").isNotNull())
    judged = cut(found.groupBy(F.col("row_key").alias(other)).agg(F.first(F.when(F.col("kept"), F.col("gone"))).alias(gone)))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "source", F.xxhash64("text")))
    # a rejected row has a key, but no lines
    kept = keyed.join(few(judged, MOST_BROADCAST), F.col(key) == F.col(other), "left").filter(F.col(other).isNull() | F.col(gone).isNotNull())
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(_normalised(x)))), "\n")
    kept = kept.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.select(*docs.columns)
