"""Design roles on the test tables, in Spark and as DuckDB common table expressions.

``embeddings``: label is the athlete, the vector a curve of 64 nodes, the rank
by vec_id the trial; vec_id mod 3 is the action. ``events``: a user's week is a
sequence. ``lineitem``: supplier and return flag are athlete and action.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curvestat.operators import curve_audit
from curvestat.operators.windows import trial_rank

NODES = 64
JOINTS = 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """athlete, trial, vec_id, y: all curves, unbalanced."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("athlete"), "vec_id", F.col("embedding").cast("array<double>").alias("y"))
    return trial_rank(e, ["athlete"], ["vec_id"])


def _balanced(df: DataFrame, cell: list[str]) -> DataFrame:
    """Rows whose rank is within the smallest cell."""
    least = df.groupBy(*cell).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return df.crossJoin(F.broadcast(least)).filter(F.col("trial") <= F.col("least")).drop("least")


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balanced(curves(spark, sf_dir), ["athlete"])


def to_nodes(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("athlete", "trial", *keep, F.posexplode("y").alias("node", "y"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_nodes(balanced(spark, sf_dir))


def action_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("athlete"), (F.col("vec_id") % 3).cast("int").alias("action"), "vec_id", F.col("embedding").cast("array<double>").alias("y"))
    return to_nodes(_balanced(trial_rank(e, ["athlete", "action"], ["vec_id"]), ["athlete", "action"]), "action")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, week, step (from 0), value: ordered points of each user's week."""
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) / 7).cast("int").alias("week"), "ts", "event_id", "event_type", "value")
    return e.withColumn("step", F.row_number().over(Window.partitionBy("user_id", "week").orderBy("ts", "event_id")) - 1)


def sequence_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir).groupBy("user_id", "week").agg(F.sort_array(F.collect_list(F.struct("step", "value"))).alias("x"))
    return s.select("user_id", "week", F.col("x.value").alias("xs"))


def joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial (label), frame, joint, x, y, z; every seventeenth (vec_id + joint) is a missing triplet."""
    c = curves(spark, sf_dir).select(F.col("athlete").alias("trial"), (F.col("trial") - 1).alias("frame"), "vec_id", "y")
    flat = curve_audit.to_joints(c, ["trial", "frame", "vec_id"], "y", JOINTS)
    lost = (F.col("vec_id") + F.col("joint")) % 17 == 0
    return flat.select("trial", "frame", "joint", *[F.when(lost, 0.0).otherwise(F.col(c)).alias(c) for c in ("x", "y", "z")])


#: DuckDB forms of the roles above.
CURVES = """c AS (SELECT label AS athlete, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS trial, embedding FROM embeddings)"""
NODES_SQL = CURVES + """,
bal AS (SELECT * FROM c WHERE trial <= (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY athlete))),
nodes AS (SELECT athlete, trial, unnest(range(0, 64))::INT AS node, unnest(embedding)::DOUBLE AS y FROM bal)"""
ALL_NODES = CURVES + """,
nodes AS (SELECT athlete, trial, unnest(range(0, 64))::INT AS node, unnest(embedding)::DOUBLE AS y FROM c)"""
CELLS = """cells AS (SELECT athlete, node, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss FROM nodes GROUP BY ALL)"""


def comp_sql(source: str, keys: str = "node", name: str = "comp") -> str:
    """CTE of one-way components from cell statistics."""
    return f"""{name}_s AS (SELECT {keys}, count(*) AS p, min(n) AS m, min(n) * var_pop(mean) * count(*) AS ssb, sum(ss) AS ssw FROM {source} GROUP BY ALL),
{name}_m AS (SELECT *, ssb / (p - 1) AS msb, ssw / (p * (m - 1)) AS msw FROM {name}_s),
{name} AS (SELECT *, msb >= msw AS interior, CASE WHEN msb >= msw THEN (msb - msw) / m ELSE 0 END AS sigma2_b,
 CASE WHEN msb >= msw THEN msw ELSE (ssb + ssw) / (p * m - 1) END AS sigma2_w FROM {name}_m)"""


WEIGHT = "CASE WHEN node IN (0, 63) THEN 0.5 / 63 ELSE 1.0 / 63 END"
ONE_WAY = f"WITH {NODES_SQL},\n{CELLS},\n{comp_sql('cells')}"
INTEGRATED = f"""{ONE_WAY},
tot AS (SELECT sum(sigma2_b * ({WEIGHT})) AS b, sum(sigma2_w * ({WEIGHT})) AS w, count(*) FILTER (NOT interior) AS boundary_nodes, count(*) AS q FROM comp)"""
SEQ = """seq AS (SELECT user_id, floor((ts::DATE - DATE '1970-01-01') / 7)::INT AS week, ts, event_id, event_type, value,
 row_number() OVER (PARTITION BY user_id, floor((ts::DATE - DATE '1970-01-01') / 7) ORDER BY ts, event_id) - 1 AS step FROM events)"""
SEQ_ARRAYS = SEQ + """,
arr AS (SELECT user_id, week, list(value ORDER BY step) AS xs, count(*) AS n FROM seq GROUP BY ALL)"""
JOINTS_SQL = CURVES + """,
f AS (SELECT athlete AS trial, trial - 1 AS frame, vec_id, embedding, unnest(range(1, 15))::INT AS joint FROM c),
j AS (SELECT trial, frame, joint, (vec_id + joint) % 17 = 0 AS lost, embedding[3 * joint - 2]::DOUBLE AS x0, embedding[3 * joint - 1]::DOUBLE AS y0, embedding[3 * joint]::DOUBLE AS z0 FROM f),
joints AS (SELECT trial, frame, joint, CASE WHEN lost THEN 0.0::DOUBLE ELSE x0 END AS x, CASE WHEN lost THEN 0.0::DOUBLE ELSE y0 END AS y, CASE WHEN lost THEN 0.0::DOUBLE ELSE z0 END AS z FROM j),
zj AS (SELECT *, x = 0 AND y = 0 AND z = 0 AS zero FROM joints)"""
STEPS = JOINTS_SQL + """,
lagged AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, lag(zero) OVER w AS pzero FROM zj WINDOW w AS (PARTITION BY trial, joint ORDER BY frame)),
steps AS (SELECT trial, joint, frame - 1 AS step, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS moved, NOT (zero OR pzero) AS valid FROM lagged WHERE px IS NOT NULL)"""


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison; negative zero becomes zero."""
    return df.select(*[(F.round(c, special.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"
