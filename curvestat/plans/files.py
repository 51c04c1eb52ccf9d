"""Queries of sources and sinks: tables that go out through a sink and come back through a source, and checks of what is read."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvestat.catalog import CORE
from curvestat.functions import arrays
from curvestat.operators import checks
from curvestat.operators.curve_audit import is_zero
from curvestat.operators.lineage import cut
from curvestat.plans import designs as D
from curvestat.sources import coordinates, npy, sinks

query = CORE.query


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read with a declared schema."""
    t = D.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    path = sinks.scratch(spark, "csv")
    sinks.write_csv(t, path)
    return coordinates.read_table(spark, path, t.schema)


@query("csv_rounded_round_trip", "SELECT p_partkey, round(p_retailprice / 3, 4) AS third FROM part")
def csv_rounded_round_trip(spark, sf_dir):
    """Doubles written with twelve significant digits behind a byte-order mark."""
    t = D.table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("price")).withColumn("third", F.col("price") / 3).select("p_partkey", "third")
    path = sinks.scratch(spark, "rounded")
    sinks.write_csv_rounded(t, path)
    return D.rounded(coordinates.read_table(spark, path, t.schema), 4)


@query(
    "csv_byte_order_mark",
    "SELECT 'efbbbf' AS first_bytes, sha256(chr(65279) || 'n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation",
)
def csv_byte_order_mark(spark, sf_dir):
    """The first bytes and the digest of a file of the second CSV dialect, mark, header and rows."""
    path = sinks.scratch(spark, "marked")
    sinks.write_csv_rounded(D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey"), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return files.select(F.lower(F.hex(F.substring("content", 1, 3))).alias("first_bytes"), F.sha2("content", 256).alias("sha256"))


def _cube(spark, sf_dir):
    """Embeddings as curves of two waveforms: either half of a vector."""
    c = D.curves(spark, sf_dir).select(F.col("athlete").cast("int").alias("participant"), (F.col("vec_id") % 3).cast("int").alias("action"), F.col("trial").cast("int").alias("trial"), "y")
    half = lambda name, at: c.select(F.lit(name).alias("waveform"), "participant", "action", "trial", F.slice("y", at, 32).alias("y"))
    return half("racket", 1).unionByName(half("body", 33))


@query(
    "curve_round_trip",
    f"""WITH {D.CURVES}, w AS (SELECT 'racket' AS waveform, athlete::INT AS participant, (vec_id % 3)::INT AS action, trial::INT AS trial, embedding[1:32] AS y FROM c UNION ALL SELECT 'body', athlete::INT, (vec_id % 3)::INT, trial::INT, embedding[33:64] FROM c)
SELECT waveform, participant, action, trial, {D.r('y[1]::DOUBLE', 'first')}, {D.r('list_sum(list_transform(y, lambda v: v::DOUBLE))', 'total')} FROM w""",
)
def curve_round_trip(spark, sf_dir):
    path = sinks.scratch(spark, "curves")
    sinks.write_curves(_cube(spark, sf_dir), path)
    back = coordinates.read_curves(spark, path)
    total = F.aggregate("y", F.lit(0.0), lambda acc, v: acc + v)
    return D.rounded(back.select("waveform", "participant", "action", "trial", F.get("y", F.lit(0)).alias("first"), total.alias("total")))


@query(
    "npy_cube_round_trip",
    f"""WITH {D.NODES_SQL}, w AS (SELECT athlete, trial, vec_id, unnest([0, 1])::BIGINT AS waveform, embedding FROM bal), l AS (SELECT athlete, dense_rank() OVER (ORDER BY athlete) - 1 AS at_athlete FROM bal GROUP BY athlete),
h AS (SELECT waveform, at_athlete, (trial - 1)::BIGINT AS at_trial, CASE WHEN waveform = 0 THEN embedding[1:32] ELSE embedding[33:64] END AS y FROM w JOIN l USING (athlete))
SELECT waveform, at_athlete, at_trial, {D.r('y[1]::DOUBLE', 'first')}, {D.r('y[32]::DOUBLE', 'last')}, {D.r('list_sum(list_transform(y, lambda v: v::DOUBLE))', 'total')} FROM h""",
)
def npy_cube_round_trip(spark, sf_dir):
    """Curves of the smallest cell's size as a four-axis .npy cube (waveform, athlete, trial, node) and back."""
    placed, athletes = npy.positions(D.balanced(spark, sf_dir), "athlete", "at_athlete")
    halves = F.array(*[F.struct(F.lit(i).alias("waveform"), F.slice("y", 1 + 32 * i, 32).alias("y")) for i in range(2)])
    curves = cut(placed.select("at_athlete", (F.col("trial") - 1).alias("at_trial"), F.inline(halves)))
    trials = curves.agg(F.max("at_trial")).first()[0]
    path = sinks.scratch(spark, "cube") + ".npy"
    npy.write_cube(curves, path, {"waveform": 2, "at_athlete": athletes, "at_trial": 0 if trials is None else trials + 1}, 32)
    back = npy.read_cube(spark, path, ["waveform", "at_athlete", "at_trial"])
    total = F.aggregate("y", F.lit(0.0), lambda acc, v: acc + v)
    out = cut(D.rounded(back.select("waveform", "at_athlete", "at_trial", F.get("y", F.lit(0)).alias("first"), F.get("y", F.lit(31)).alias("last"), total.alias("total"))))
    sinks.remove(spark, path)
    return out


@query("cube_digests", "SELECT waveform, (SELECT count(*) FROM embeddings) AS curves, true AS unchanged FROM (VALUES ('racket'), ('body')) t(waveform)")
def cube_digests(spark, sf_dir):
    """Digests of a written cube against those of its source, and of its copy under a second name."""
    cube, path = _cube(spark, sf_dir), sinks.scratch(spark, "cube")
    written = sinks.write_curves(cube, path)
    named = sinks.cube_digest(sinks.second_name(spark, path, sinks.scratch(spark, "cube-too")))
    of = lambda df, name: df.select("waveform", F.col("sha256").alias(name))
    joined = written.join(of(sinks.cube_digest(cube), "source"), "waveform").join(of(named, "copied"), "waveform")
    return joined.select("waveform", "curves", ((F.col("sha256") == F.col("source")) & (F.col("sha256") == F.col("copied"))).alias("unchanged"))


@query(
    "file_inventory",
    "SELECT 'n_regionkey=' || n_regionkey AS folder, sum(strlen(n_name) + 1)::BIGINT AS bytes, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation GROUP BY n_regionkey",
)
def file_inventory(spark, sf_dir):
    """Folder below the root, size and hash of each file that a text sink wrote, one for each region."""
    path = sinks.scratch(spark, "inventory")
    t = D.table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_regionkey", "n_nationkey")
    t.select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    return sinks.inventory(spark, path, "(^|/)_").select(F.substring_index("path", "/", 1).alias("folder"), "bytes", "sha256")


@query("padding_is_zero", "SELECT vec_id FROM embeddings WHERE vec_id % 13 = 0 AND len(list_filter(embedding[41:64], lambda v: v <> 0)) > 0")
def padding_is_zero(spark, sf_dir):
    """Trials whose padding behind 40 observed frames isn't zero; every thirteenth keeps its values there."""
    e = D.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("y"))
    padded = F.when(F.col("vec_id") % 13 == 0, F.col("y")).otherwise(F.concat(F.slice("y", 1, 40), F.array_repeat(F.lit(0.0), 24)))
    return e.withColumn("y", padded).filter(~arrays.tail_is_zero(F.col("y"), F.lit(40))).select("vec_id")


@query("racket_gaps", f"WITH {D.JOINTS_SQL} SELECT trial, count(*) AS gaps FROM zj WHERE zero AND joint <= 2 GROUP BY trial")
def racket_gaps(spark, sf_dir):
    """Missing triplets in the racket's two joints, which may have none."""
    return D.joints(spark, sf_dir).filter((F.col("joint") <= 2) & is_zero()).groupBy("trial").agg(F.count("*").alias("gaps"))


@query("unequal_pair_lengths", "SELECT vec_id FROM embeddings WHERE vec_id % 11 = 0")
def unequal_pair_lengths(spark, sf_dir):
    """Pairs of racket and body curves of unequal length; every eleventh body curve lacks a frame."""
    e = D.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("racket"), F.slice("embedding", F.lit(33), F.when(F.col("vec_id") % 11 == 0, 31).otherwise(32)).alias("body"))
    return checks.unequal_lengths(e, "racket", "body").select("vec_id")


@query("forbidden_tokens", """SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(token|password|secret) *= *"')""")
def forbidden_tokens(spark, sf_dir):
    """Rows that a release may not hold."""
    return checks.forbidden(D.table(spark, sf_dir, "documents"), "text", r'(?i)(token|password|secret) *= *"').select("doc_id")


_WANTED = {"nation": ["n_nationkey", "n_name", "n_capital"], "region": ["r_regionkey", "r_name"], "embeddings": ["vec_id", "embedding", "label", "split"]}


@query(
    "release_columns",
    "SELECT name, missing FROM (VALUES " + ", ".join(f"('{name}', '{c}')" for name, columns in _WANTED.items() for c in columns) + ") w(name, missing) ANTI JOIN information_schema.columns i ON i.table_name = w.name AND i.column_name = w.missing",
)
def release_columns(spark, sf_dir):
    """Columns that a release asks for and tables don't have."""
    rows = [(name, c) for name, columns in _WANTED.items() for c in checks.missing_columns(D.table(spark, sf_dir, name), columns)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("name", T.StringType()), T.StructField("missing", T.StringType())]))
