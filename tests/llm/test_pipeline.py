from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from curvestat.llm import quality_rules, simhash
from tests.llm.common import documents, frame, prose
from tests.llm.test_mixing import water, words
from tests.llm.test_quality import brute
from tests.llm.test_simhash import brute_components, fingerprint


def test_pipeline_against_brute_force(spark, tmp_path):
    item = prose(7777, 40)
    rows = documents() + [(700 + i, prose(700 + i, 60) + "\n" + item, "en", "src0", 0) for i in range(3)] + [(800, "$$ " * 80, "en", "src1", 0)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]

    kept = [r for r, v in zip(rows, brute(rows, quality_rules.MIN_TEXTS, quality_rules.SHARE, quality_rules.MIN_LEFT), strict=True) if v[-1]]
    prints = [fingerprint(r[1]) for r in kept]
    roots, seen, single = brute_components(prints), {}, []
    for r, root in sorted(zip(kept, roots, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if root not in seen:
            seen[root] = r
            single.append(r)
    clean = [r for r in single if item not in (r[1] or "")]

    out = P.run(spark, str(tmp_path))
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    by_id = {r[0]: r for r in clean}
    assert {r["doc_id"] for r in got} <= set(by_id) and all(by_id[r["doc_id"]][1] == r["text"] for r in got)
    sizes = Counter()
    for r in clean:
        sizes[r[3]] += words(r[1])
    goal, most, taken = water(dict(sizes)), Counter(), Counter()
    for r in clean:
        most[r[3]] = max(most[r[3]], words(r[1]))
    for r in got:
        taken[r["source"]] += words(r["text"])
    assert all(abs(taken[s] - goal[s]) <= most[s] + 1e-6 for s in sizes)
    assert max(Counter(r["doc_id"] for r in got).values()) <= 2
    slots = Counter((r["shard"], r["slot"]) for r in got)
    per = Counter(r["shard"] for r in got)
    assert max(slots.values()) == 1 and max(per.values()) - min(per.get(s, 0) for s in range(40)) <= 1


def test_stages_on_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
    assert simhash.classes(frame(spark, [])).select(F.count("*")).first()[0] == 0


def test_quality_limit_does_not_grow_with_the_source(spark):
    """A line of 12 of 100 texts, a quarter of their words, is below a fifth of the source but boilerplate."""
    line = " ".join(f"shared{i}" for i in range(30))
    rows = [(i, prose(3000 + i, 90) + (f"\n{line}" if i < 12 else ""), "en", "big", 0) for i in range(100)]
    assert {r["doc_id"] for r in P.quality_stage(spark, frame(spark, rows), "").collect()} == set(range(12, 100))
