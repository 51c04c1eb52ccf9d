"""Merkle manifest of a dataset: a leaf for each row, a tree for each language, a tree over their roots.

H is the lower-case hex SHA-256 of its concatenated inputs, digests as hex text. A
leaf is H of doc_id, source, lang, n_chars and text, each ``-`` if null, else its UTF-8
byte count, a colon and the value. Leaves of a language ascend by doc_id (null
first), then by leaf; while several nodes remain, every ``FAN`` consecutive ones
become their H. Subroots, by language (null first, bytewise), become the root alike.

Leaves are hashed in the scan, by Spark; texts go no further. Places come from a range
partitioning by (language, doc_id, leaf, number of the row) and counts of its parts, so a
language, or a doc_id, that holds most rows is many parts. Rows are then dealt into
buckets of ``FAN ** LEVELS`` consecutive places, aligned to the tree, and each bucket goes as
one Arrow table to DuckDB in an executor, where ordered string_agg and sha256 make
its levels. Spark takes the bucket roots as the nodes of the next round until one is left, joins
each bucket's outer path (the runs above it) back, and a second query per bucket makes the proofs and
folds the paths of altered leaves. A task holds one bucket at a time, and a path grows with the logarithm of
the rows.

Tampering stands for a changed copy: where 3 divides the CRC-32 of the decimal doc_id, A-Z in
text are lower-cased. folded_root is recomputed from that leaf and the proof.

Defined results: repeated rows are leaves of their own at consecutive places; a null doc_id
comes first and isn't tampered with; a single row is its own root with the H of nothing as proof; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvestat.llm.common import cut, few

FAN = 8
#: Levels of a bucket.
LEVELS = 4
BUCKET = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 3
#: Rows up to which a table of counts is broadcast.
MOST_BROADCAST = 500_000

PATH = "runs array<string>, at array<int>"


def depth(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def leaf(columns: dict[str, Column]) -> Column:
    """H of the fields."""
    said = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (columns[f].cast("string") for f in FIELDS)]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (language), leaf, tampered (the altered copy's leaf; null where nothing is altered) and a number of the row."""
    columns = {f: F.col(f) for f in FIELDS}
    altered = columns | {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    is_altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    rows = docs.select("doc_id", tree.alias("tree"), leaf(columns).alias("leaf"), F.when(is_altered, leaf(altered)).alias("tampered"))
    return cut(rows.withColumn("number", F.monotonically_increasing_id()))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, from 0 in each tree by the columns of order, and the tree's size n. rows: cut, different in (tree, order)."""
    names = rows.columns

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree").to_numpy(zero_copy_only=False)
            first = np.concatenate([[tree[0] != last], tree[1:] != tree[:-1]])
            began = np.maximum.accumulate(np.where(first, np.arange(len(tree)), -held))
            local = np.arange(len(tree)) - began
            last, held = tree[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(tree), part, dtype=np.int64)), pa.array(local)], names=[*names, "part", "local"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    local = cut(ranged.mapInArrow(numbered, f"{kinds}, part bigint, local bigint"))
    parts = local.groupBy("tree", "part").agg(F.count("*").alias("held"))
    upto = Window.partitionBy("tree").orderBy("part")
    offsets = cut(parts.select("tree", "part", (F.sum("held").over(upto) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy("tree")).alias("n")))
    return local.join(few(offsets, MOST_BROADCAST), ["tree", "part"]).select(*names, (F.col("before") + F.col("local")).alias("pos"), "n")


@cache
def _engine():
    """A DuckDB of the worker's own, in memory and in one thread."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1})


def _levels(levels: int) -> str:
    """CTEs: level0 (pos, node) of the bucket's rows, and for each level its runs (up, run) and the level above."""
    out = ["level0 AS (SELECT pos, node FROM bucket)"]
    for k in range(levels):
        out.append(f"runs{k} AS (SELECT pos // {FAN} AS up, string_agg(node, '' ORDER BY pos) AS run FROM level{k} GROUP BY 1)")
        out.append(f"level{k + 1} AS (SELECT up AS pos, sha256(run) AS node FROM runs{k})")
    return "WITH " + ", ".join(out)


def _joined(levels: int) -> str:
    return "bucket" + "".join(f" JOIN runs{k} ON bucket.pos // {FAN ** (k + 1)} = runs{k}.up" for k in range(levels))


def _at(k: int) -> str:
    return f"(bucket.pos // {FAN**k}) % {FAN}"


@cache
def top_sql(levels: int) -> str:
    """Root of a bucket."""
    return f"{_levels(levels)} SELECT node FROM level{levels}"


@cache
def path_sql(levels: int) -> str:
    """Runs above each node of a bucket and its place in them, continued by the bucket's own path."""
    runs, at = (", ".join(x) for x in ([f"runs{k}.run" for k in range(levels)], [f"({_at(k)})::INTEGER" for k in range(levels)]))
    return f"{_levels(levels)} SELECT bucket.pos AS pos, list_concat([{runs}]::VARCHAR[], $runs::VARCHAR[]) AS runs, list_concat([{at}]::INTEGER[], $at::INTEGER[]) AS at FROM {_joined(levels)}"


@cache
def proof_sql(levels: int, outer: int) -> str:
    """Proof of each leaf of a bucket and the root folded from its altered copy; r0, a0 and so on: the bucket's path."""
    steps = [(f"runs{k}.run", _at(k)) for k in range(levels)] + [(f"$r{k}::VARCHAR", f"$a{k}::INTEGER") for k in range(outer)]
    left, right = (lambda run, at: f"left({run}, 64 * ({at}))"), (lambda run, at: f"substr({run}, 64 * ({at}) + 65)")
    folded = "coalesce(bucket.tampered, bucket.node)"
    siblings = " || ".join(["''", *(f"{left(*s)} || {right(*s)}" for s in steps)])
    for step in steps:
        folded = f"sha256({left(*step)} || {folded} || {right(*step)})"
    return f"{_levels(levels)} SELECT bucket.doc_id AS doc_id, bucket.node AS leaf, sha256({siblings}) AS proof_sha256, {folded} AS folded_root FROM {_joined(levels)}"


def _asked(sql: str, bucket: pa.Table, values: dict | None = None) -> pa.Table:
    engine = _engine()
    engine.register("bucket", bucket)
    out = engine.sql(sql, params=values or None).to_arrow_table()
    engine.unregister("bucket")
    return out


def _bucketed(nodes: DataFrame):
    return nodes.withColumn("bucket", F.floor(F.col("pos") / BUCKET)).groupBy("tree", "bucket")


def tops(nodes: DataFrame) -> DataFrame:
    """Roots of the buckets of nodes (tree, pos, n, node), as the nodes of the next round."""

    def top(bucket: pa.Table) -> pa.Table:
        n = bucket["n"][0].as_py()
        node = _asked(top_sql(min(LEVELS, depth(n))), bucket)["node"][0].as_py()
        place = bucket["pos"][0].as_py() // BUCKET
        return pa.table({"tree": pa.array([bucket["tree"][0].as_py()]), "pos": [place], "n": [-(-n // BUCKET)], "node": pa.array([node])})

    return cut(_bucketed(nodes.select("tree", "pos", "n", "node")).applyInArrow(top, "tree string, pos bigint, n bigint, node string"))


def _with_outer(nodes: DataFrame, outer: DataFrame, made: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """made(bucket, its row of outer (tree, bucket, ...)) of each bucket."""
    return _bucketed(nodes).cogroup(outer.groupBy("tree", "bucket")).applyInArrow(made, schema)


def paths(nodes: DataFrame) -> DataFrame:
    """tree, pos, root of the tree, and runs and at: the runs above each node (tree, pos, n, node) and its place in them."""
    if nodes.filter("n > 1").isEmpty():
        return nodes.select("tree", "pos", F.col("node").alias("root"), F.array().cast("array<string>").alias("runs"), F.array().cast("array<int>").alias("at"))

    def path(bucket: pa.Table, outer: pa.Table) -> pa.Table:
        beyond = {k: outer[k][0].as_py() for k in ("runs", "at")}
        found = _asked(path_sql(min(LEVELS, depth(bucket["n"][0].as_py()))), bucket, beyond)
        same = lambda table, name: pa.array([table[name][0].as_py()] * len(found), pa.string())
        return pa.table({"tree": same(bucket, "tree"), "pos": found["pos"], "root": same(outer, "root"), "runs": found["runs"].cast(pa.list_(pa.string())), "at": found["at"].cast(pa.list_(pa.int32()))})

    above = paths(tops(nodes)).withColumnRenamed("pos", "bucket")
    return cut(_with_outer(nodes, above, path, f"tree string, pos bigint, root string, {PATH}"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs."""
    rows = cut(placed(leaves(docs), ["doc_id", "leaf", "number"]).withColumnRenamed("leaf", "node"))
    inner = cut(paths(tops(rows)))
    subroots = cut(inner.filter("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("language"), F.col("root").alias("node")))
    upper = placed(subroots, ["language"])
    above = paths(upper.select("tree", "pos", "n", "node")).select("pos", F.col("root").alias("whole"), F.col("runs").alias("more_runs"), F.col("at").alias("more_at"))
    top = cut(upper.select("language", "pos").join(above, "pos").drop("pos"))
    outer = inner.join(top, inner["tree"] == top["language"]).select("tree", F.col("pos").alias("bucket"), F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("runs", "more_runs").alias("runs"), F.concat("at", "more_at").alias("at"))

    def proof(bucket: pa.Table, beyond: pa.Table) -> pa.Table:
        runs, at = (beyond[k][0].as_py() for k in ("runs", "at"))
        values = {f"r{k}": x for k, x in enumerate(runs)} | {f"a{k}": x for k, x in enumerate(at)}
        found = _asked(proof_sql(min(LEVELS, depth(bucket["n"][0].as_py())), len(runs)), bucket, values)
        subroot, root = (pa.array([beyond[k][0].as_py()] * len(found), pa.string()) for k in ("subroot", "root"))
        said = {"doc_id": found["doc_id"].cast(bucket["doc_id"].type), "leaf": found["leaf"], "subroot": subroot, "root": root, "proof_sha256": found["proof_sha256"], "folded_root": found["folded_root"]}
        return pa.table(said)

    kind = docs.schema["doc_id"].dataType.simpleString()
    digests = ", ".join(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
    found = _with_outer(rows.select("tree", "pos", "n", "node", "doc_id", "tampered"), outer, proof, f"doc_id {kind}, {digests}")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
