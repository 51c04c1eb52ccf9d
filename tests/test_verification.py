"""Tolerant comparison of tables, and tree digests."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from curvestat.operators import golden, tree_digest

INF, NAN = float("inf"), float("nan")


def test_rules_of_numbers(spark):
    cases = [
        (1.0, 1.0, True), (1.0, 1.0 + 5e-7, True), (1.0, 1.1, False), (100.0, 100.09, True), (100.0, 100.2, False), (None, None, True), (None, 1.0, False), (1.0, None, False),
        (NAN, NAN, True), (NAN, 1.0, False), (1.0, NAN, False), (NAN, None, False), (INF, INF, True), (INF, -INF, False), (INF, 1.0, False), (1.0, INF, False), (0.0, -0.0, True),
    ]
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(cases)], "i int, a double, e double")
    got = {r["i"]: r["same"] for r in df.select("i", golden.agrees(F.col("a"), F.col("e"), 1e-6, 1e-3).alias("same")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_report_of_differences(spark):
    kind = "k string, n int, x double, s string"
    expected = spark.createDataFrame([("a", 1, 1.0, "u"), ("b", 2, 2.0, "v"), (None, 3, None, None), ("d", 4, 4.0, "w"), ("e", 5, 5.0, "z")], kind)
    actual = spark.createDataFrame([("a", 1, 1.0 + 1e-12, "u"), ("b", 3, 2.5, "v"), (None, 3, 0.0, None), ("e", 5, 5.0, None), ("f", 6, 6.0, "y"), ("g", 7, 7.0, "q"), ("g", 7, 7.0, "q")], kind)
    got = {(r["k"], r["column"], r["problem"]): (r["actual"], r["expected"]) for r in golden.differences(actual, expected, ["k"], {"x": (1e-9, 0.0)}).collect()}
    assert got == {
        ("b", "n", "differs"): ("3", "2"), ("b", "x", "differs"): ("2.5", "2.0"), (None, "x", "differs"): ("0.0", None), ("d", None, "missing"): (None, "1"),
        ("e", "s", "differs"): (None, "z"), ("f", None, "extra"): ("1", None), ("g", None, "repeated"): ("2", None),
    }
    golden.require_equal(expected, expected, ["k"])
    with pytest.raises(ValueError, match="differ"):
        golden.require_equal(actual, expected, ["k"])
    with pytest.raises(ValueError, match="lacks"):
        golden.differences(actual.drop("x"), expected, ["k"])
    assert golden.differences(actual.select("k", "n"), expected, ["k"], columns=[]).filter("problem = 'differs'").count() == 0


def plain_root(rows, fan):
    """Digest of {(outer, inner): digest} by the definition, one key after another."""
    sha = lambda items: hashlib.sha256(";".join(f"{k}:{d}" for k, d in sorted(items)).encode()).hexdigest()

    def folded(level, times):
        for _ in range(times):
            quotients = {}
            for k, d in level.items():
                quotients.setdefault(k // fan, []).append((k, d))
            level = {q: sha(items) for q, items in quotients.items()}
        return level[0]

    times = [tree_digest.levels(max(k[i] for k in rows), fan) for i in (0, 1)]
    outer = {}
    for (a, b), d in rows.items():
        outer.setdefault(a, {})[b] = d
    return folded({a: folded(inner, times[1]) for a, inner in outer.items()}, times[0])


@pytest.mark.parametrize("fan", [2, 4, 64])
def test_root_is_that_of_the_definition(spark, fan):
    draw = random.Random(fan)
    rows = {(draw.randrange(9), draw.randrange(70)): hashlib.sha256(str(i).encode()).hexdigest() for i in range(120)}
    df = spark.createDataFrame([("w", a, b, d) for (a, b), d in rows.items()], "g string, a int, b bigint, digest string")
    (r,) = tree_digest.root(df.repartition(3), ["g"], ["a", "b"], fan=fan).collect()
    assert (r["digest"], r["rows"]) == (plain_root(rows, fan), len(rows))


def test_any_change_shows_and_is_found(spark):
    kind = "g string, a int, b int, digest string"
    rows = [(g, a, b, hashlib.sha256(f"{g}{a}{b}".encode()).hexdigest()) for g in "xy" for a in range(3) for b in range(20)]
    base = spark.createDataFrame(rows, kind)
    roots = lambda df: {r["g"]: r["digest"] for r in tree_digest.root(df, ["g"], ["a", "b"], fan=4).collect()}
    whole = roots(base)
    altered = [*rows[:7], ("x", 0, 7, "0" * 64), *rows[8:]]
    missing = rows[:7] + rows[8:]
    moved = [(g, a, (b + 1) % 20 if (g, a) == ("x", 1) else b, d) for g, a, b, d in rows]
    for other, problems in ((altered, {("altered", 7)}), (missing, {("missing", 7)}), (moved, None), ([*rows, ("x", 2, 20, "1" * 64)], {("further", 20)})):
        df = spark.createDataFrame(other, kind)
        got = roots(df)
        assert got["x"] != whole["x"] and got["y"] == whole["y"]
        found = tree_digest.changed(df, base, ["g"], ["a", "b"], fan=4).collect()
        assert all(r["g"] == "x" for r in found) and len(found) == (20 if problems is None else 1)
        if problems:
            assert {({"missing": "missing", "further": "further"}.get(r["problem"], r["problem"]), r["b"]) for r in found} == problems
    with pytest.raises(ValueError):
        tree_digest.root(spark.createDataFrame([("x", -1, 0, "a")], kind), ["g"], ["a", "b"])
    assert tree_digest.root(base.limit(0), ["g"], ["a", "b"]).count() == 0


def test_trials_above_4095_give_the_digests_of_the_sql(spark, tmp_path):
    import duckdb

    from curvestat.catalog import CORE
    from curvestat.plans import load_all

    load_all()
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(F.col("id") * (i + 1)).cast("float"))
    # label 1 has 4,200 trials, label 2 the others
    e = spark.range(4500).select(F.col("id").alias("vec_id"), values.alias("embedding"), F.when(F.col("id") % 15 == 7, 2).otherwise(1).alias("label"))
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = CORE.builders["curve_tree_digest"](spark, str(tmp_path)), con.sql(CORE.oracles["curve_tree_digest"]).fetchall()
    assert {tuple(r) for r in got.select("waveform", "sha256", "curves").collect()} == set(want) and len(want) == 2


def test_fewer_divisions_bring_the_other_quotients_together(spark):
    rows = {(a, b): hashlib.sha256(f"{a}{b}".encode()).hexdigest() for a in range(3) for b in range(40)}
    df = spark.createDataFrame([("w", a, b, d) for (a, b), d in rows.items()], "g string, a int, b bigint, digest string")
    one = lambda parts: hashlib.sha256(";".join(f"{k}:{d}" for k, d in sorted(parts)).encode()).hexdigest()
    inner = [(a, one([(q, one([(b, rows[a, b]) for b in range(40) if b // 4 == q])) for q in range(10)])) for a in range(3)]
    (r,) = tree_digest.root(df, ["g"], ["a", "b"], fan=4, deepest={"b": 2}).collect()
    assert (r["digest"], r["rows"]) == (one(inner), 120)
    with pytest.raises(ValueError):
        tree_digest.root(df, ["g"], ["a", "b"], deepest={"b": 0})
