"""Queries of per-sequence curve operators and of joint frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvestat.catalog import CORE
from curvestat.functions import arrays as A
from curvestat.operators import curve_audit as Q
from curvestat.operators import influence, windows
from curvestat.plans import designs as D
from curvestat.plans.designs import r

query = CORE.query


@query(
    "sequence_displacement",
    f"WITH {D.SEQ}, d AS (SELECT user_id, week, step - 1 AS step, abs(value - lag(value) OVER (PARTITION BY user_id, week ORDER BY step)) AS moved FROM seq) SELECT user_id, week, step::INT AS step, {r('moved', 'moved')} FROM d WHERE moved IS NOT NULL",
)
def sequence_displacement(spark, sf_dir):
    a = D.sequence_arrays(spark, sf_dir)
    return D.rounded(a.select("user_id", "week", F.posexplode(A.displacement(F.col("xs"))).alias("step", "moved")))


@query(
    "phase_normalise",
    f"""WITH {D.SEQ_ARRAYS}, g AS (SELECT user_id, week, xs, n, unnest(range(0, 20))::INT AS node FROM arr WHERE n >= 2),
p AS (SELECT *, node * (n - 1) / 19.0::DOUBLE AS pos FROM g), l AS (SELECT *, least(floor(pos), n - 2)::INT AS lo FROM p)
SELECT user_id, week, node, {r('xs[lo + 1] * (1 - (pos - lo)) + xs[lo + 2] * (pos - lo)', 'y')} FROM l""",
)
def phase_normalise(spark, sf_dir):
    a = D.sequence_arrays(spark, sf_dir).withColumn("y", A.phase_normalise(F.col("xs"), 20)).filter("y IS NOT NULL")
    return D.rounded(a.select("user_id", "week", F.posexplode("y").alias("node", "y")))


@query("short_sequences", f"WITH {D.SEQ_ARRAYS} SELECT user_id, week, n AS points FROM arr WHERE n < 2")
def short_sequences(spark, sf_dir):
    """Sequences without a phase curve; they are reported, never filled."""
    a = D.sequence_arrays(spark, sf_dir)
    return a.filter(A.phase_normalise(F.col("xs"), 20).isNull()).select("user_id", "week", F.size("xs").cast("bigint").alias("points"))


@query("displacement_xyz", f"WITH {D.STEPS} SELECT trial, joint, step, {r('moved', 'moved')}, valid FROM steps")
def displacement_xyz(spark, sf_dir):
    s = Q.steps(D.joints(spark, sf_dir), ["trial"])
    return D.rounded(s.select("trial", "joint", F.col("step").cast("bigint").alias("step"), "moved", "valid"))


@query(
    "body_curves",
    f"WITH {D.STEPS} SELECT trial, step, {r('avg(moved)', 'naive')}, {r('avg(moved) FILTER (valid)', 'structural')}, count(*) FILTER (valid) AS valid_joints FROM steps GROUP BY ALL",
)
def body_curves(spark, sf_dir):
    s = Q.steps(D.joints(spark, sf_dir), ["trial"])
    both = Q.both_body_curves(s, ["trial"])
    return D.rounded(both.select("trial", F.col("step").cast("bigint").alias("step"), "naive", "structural", "valid_joints"))


@query("fixed_joint_curves", f"WITH {D.STEPS} SELECT trial, step, {r('avg(moved) FILTER (valid)', 'moved')}, count(*) FILTER (valid) AS valid_joints FROM steps WHERE joint IN (1, 2, 3, 4, 5, 6, 11, 14) GROUP BY ALL")
def fixed_joint_curves(spark, sf_dir):
    from curvestat.schema import VARIANTS

    chosen = D.joints(spark, sf_dir).filter(F.col("joint").isin(*VARIANTS["fixed8"][0]))
    s = Q.structural_body_curve(Q.steps(chosen, ["trial"]), ["trial"])
    return D.rounded(s.select("trial", F.col("step").cast("bigint").alias("step"), "moved", "valid_joints"))


@query("too_few_joints", f"WITH {D.STEPS} SELECT trial, step, valid_joints FROM (SELECT trial, step, count(*) FILTER (valid) AS valid_joints FROM steps GROUP BY ALL) WHERE valid_joints < 13")
def too_few_joints(spark, sf_dir):
    curve = Q.structural_body_curve(Q.steps(D.joints(spark, sf_dir), ["trial"]), ["trial"])
    return Q.too_few_joints(curve, 13).select("trial", F.col("step").cast("bigint").alias("step"), "valid_joints")


@query("zero_triplets", f"WITH {D.JOINTS_SQL} SELECT trial, frame, joint FROM zj WHERE zero")
def zero_triplets(spark, sf_dir):
    return D.joints(spark, sf_dir).filter(Q.is_zero()).select("trial", F.col("frame").cast("bigint").alias("frame"), "joint")


@query(
    "run_extraction",
    f"""WITH {D.SEQ}, e AS (SELECT *, min(step) OVER w AS lo, max(step) OVER w AS hi FROM seq WINDOW w AS (PARTITION BY user_id, week)),
f AS (SELECT *, step - row_number() OVER (PARTITION BY user_id, week ORDER BY step) AS island FROM e WHERE value < 20)
SELECT user_id, week, min(step) AS first, max(step) AS last, count(*) AS run_length, min(step) = min(lo) AS touches_start, max(step) = min(hi) AS touches_end FROM f GROUP BY user_id, week, island""",
)
def run_extraction(spark, sf_dir):
    s = D.sequences(spark, sf_dir).select(F.struct("user_id", "week").alias("trial"), F.col("step").cast("bigint").alias("frame"), F.lit(1).alias("joint"), F.when(F.col("value") < 20, 0.0).otherwise(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    runs = Q.zero_runs(s, ["trial"])
    return runs.select("trial.user_id", "trial.week", "first", "last", "run_length", "touches_start", "touches_end")


@query("run_length_histogram", f"""WITH {D.JOINTS_SQL}, isl AS (SELECT *, frame - row_number() OVER (PARTITION BY trial, joint ORDER BY frame) AS island FROM zj WHERE zero),
runs AS (SELECT trial, joint, count(*) AS run_length FROM isl GROUP BY trial, joint, island) SELECT run_length, count(*) AS runs FROM runs GROUP BY run_length""")
def run_length_histogram(spark, sf_dir):
    return Q.zero_runs(D.joints(spark, sf_dir), ["trial"]).groupBy("run_length").agg(F.count("*").alias("runs"))


_LEVELS = (0.3, 0.5, 0.7)


@query("jump_counts", f"WITH {D.STEPS} SELECT trial, " + ", ".join(f"count(*) FILTER (valid AND moved > {t}) AS above_{str(t).replace('.', '_')}" for t in _LEVELS) + " FROM steps GROUP BY trial")
def jump_counts(spark, sf_dir):
    return Q.jump_counts(Q.steps(D.joints(spark, sf_dir), ["trial"]), ["trial"], _LEVELS)


@query("largest_jump", f"WITH {D.STEPS}, k AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY moved DESC, step, joint) AS place FROM steps WHERE valid) SELECT trial, {r('moved', 'jump')}, step, joint FROM k WHERE place = 1")
def largest_jump(spark, sf_dir):
    j = Q.largest_jump(Q.steps(D.joints(spark, sf_dir), ["trial"]), ["trial"])
    return D.rounded(j.select("trial", "jump", F.col("step").cast("bigint").alias("step"), F.col("joint").cast("int").alias("joint")))


@query(
    "sequence_qc",
    f"""WITH {D.STEPS}, z AS (SELECT trial, count(*) FILTER (zero) AS zero_triplets, count(DISTINCT joint) FILTER (zero) AS joints_affected FROM zj GROUP BY trial),
v AS (SELECT trial, step, count(*) FILTER (valid) AS v FROM steps GROUP BY ALL),
m AS (SELECT trial, min(v) AS min_valid, count(*) FILTER (v < 14) AS steps_below_14, count(*) FILTER (v < 13) AS steps_below_13, count(*) FILTER (v < 10) AS steps_below_10 FROM v GROUP BY trial),
q AS (SELECT trial, max(moved) FILTER (valid) AS mx, quantile_cont(moved, 0.99) FILTER (valid) AS p99 FROM steps GROUP BY trial)
SELECT trial, zero_triplets, joints_affected, min_valid, steps_below_14, steps_below_13, steps_below_10, {r('mx', 'max_jump')}, {r('p99', 'p99_jump')} FROM z LEFT JOIN m USING (trial) LEFT JOIN q USING (trial)""",
)
def sequence_qc(spark, sf_dir):
    j = D.joints(spark, sf_dir)
    return D.rounded(Q.trial_quality(j, Q.steps(j, ["trial"]), ["trial"]))


_HAMPEL = f"""WITH {D.SEQ_ARRAYS}, idx AS (SELECT user_id, week, xs, n, unnest(range(0, n))::INT AS i FROM arr),
near AS (SELECT *, xs[i + 1] AS x, list_concat(xs[greatest(i - 5, 0) + 1 : i], xs[i + 2 : i + 6]) AS near FROM idx),
med AS (SELECT *, list_median(near) AS md FROM near),
mad AS (SELECT *, list_median(list_transform(near, lambda v: abs(v - md))) AS mad FROM med),
fl AS (SELECT *, len(near) >= 4 AND x > greatest(md + 2.0 * greatest(1.4826 * mad, 2.220446049250313e-16), 1.5 * greatest(md, 2.220446049250313e-16)) AS flag FROM mad)"""


def _flagged(spark, sf_dir):
    return D.sequence_arrays(spark, sf_dir).withColumn("flags", A.hampel_flags(F.col("xs"), 5, 2.0, 1.5))


@query("hampel_flags", f"{_HAMPEL} SELECT user_id, week, i AS step, {r('x', 'value')} FROM fl WHERE flag")
def hampel_flags(spark, sf_dir):
    z = _flagged(spark, sf_dir).select("user_id", "week", F.posexplode(F.arrays_zip(F.col("xs").alias("x"), F.col("flags").alias("f"))).alias("step", "z"))
    return D.rounded(z.filter("z.f").select("user_id", "week", "step", F.col("z.x").alias("value")))


@query(
    "hampel_repair",
    f"""{_HAMPEL}, gc AS (SELECT user_id, week, count(*) FILTER (NOT flag) AS good FROM fl GROUP BY ALL),
nb AS (SELECT *, max(CASE WHEN NOT flag THEN i END) OVER (PARTITION BY user_id, week ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
 min(CASE WHEN NOT flag THEN i END) OVER (PARTITION BY user_id, week ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM fl)
SELECT user_id, week, i AS step, {r('CASE WHEN NOT flag THEN x WHEN a IS NULL THEN xs[b + 1] WHEN b IS NULL THEN xs[a + 1] ELSE xs[a + 1] + (xs[b + 1] - xs[a + 1]) * (i - a) / (b - a) END', 'value')} FROM nb JOIN gc USING (user_id, week) WHERE good >= 2""",
)
def hampel_repair(spark, sf_dir):
    z = _flagged(spark, sf_dir).withColumn("fixed", A.repair(F.col("xs"), F.col("flags"))).filter("fixed IS NOT NULL")
    return D.rounded(z.select("user_id", "week", F.posexplode("fixed").alias("step", "value")))


@query(
    "flag_lists",
    f"""{_HAMPEL} SELECT user_id, week, coalesce(string_agg(i::VARCHAR, ';' ORDER BY i) FILTER (flag), '') AS steps, coalesce(string_agg(printf('%.6f', 100.0::DOUBLE * i / greatest(n - 1, 1)), ';' ORDER BY i) FILTER (flag), '') AS time_pct FROM fl GROUP BY user_id, week""",
)
def flag_lists(spark, sf_dir):
    f = _flagged(spark, sf_dir)
    steps, times = A.serialise_flags(F.col("flags"))
    return f.select("user_id", "week", steps.alias("steps"), times.alias("time_pct"))


@query(
    "explode_delimited",
    f"{_HAMPEL} SELECT user_id, week, i::VARCHAR AS steps, printf('%.6f', 100.0::DOUBLE * i / greatest(n - 1, 1)) AS time_pct FROM fl WHERE flag",
)
def explode_delimited(spark, sf_dir):
    from curvestat.operators.reshape import explode_lists

    return explode_lists(flag_lists(spark, sf_dir), ["user_id", "week"], "steps", "time_pct")


@query(
    "temporal_histogram",
    f"{_HAMPEL}, t AS (SELECT 100.0::DOUBLE * i / greatest(n - 1, 1) AS t FROM fl WHERE flag) SELECT least(floor(t / 100 * 20), 19)::INT AS bin, count(*) AS n FROM t GROUP BY bin",
)
def temporal_histogram(spark, sf_dir):
    from curvestat.operators.reshape import histogram

    exploded = explode_delimited(spark, sf_dir).select(F.col("time_pct").cast("double").alias("t"))
    return histogram(exploded, [], "t", 0.0, 100.0, 20)


@query(
    "curve_descriptors",
    f"""WITH {D.ALL_NODES} SELECT athlete, vec_id, {r('avg(y)', 'mean')}, {r('sqrt(avg(y * y))', 'rms')}, {r('quantile_cont(y, 0.99)', 'p99')}, {r('max(y)', 'largest')} FROM (SELECT athlete, vec_id, unnest(embedding)::DOUBLE AS y FROM c) GROUP BY ALL""",
)
def curve_descriptors(spark, sf_dir):
    """Mean, root mean square, 99 % quantile and maximum of each curve, from its array alone."""
    c = D.table(spark, sf_dir, "embeddings").select(F.col("label").alias("athlete"), "vec_id", F.col("embedding").cast("array<double>").alias("y"))
    total = lambda f: F.aggregate("y", F.lit(0.0), lambda acc, v: acc + f(v)) / F.size("y")
    return D.rounded(c.select("athlete", "vec_id", total(lambda v: v).alias("mean"), F.sqrt(total(lambda v: v * v)).alias("rms"), A.quantile(F.col("y"), 0.99).alias("p99"), F.array_max("y").alias("largest")))


_SMOOTH = f"""WITH {D.CURVES}, s AS (SELECT athlete, trial, vec_id, embedding AS e, list_transform(range(0, 64), lambda i: list_sum(list_transform(range(i - 5, i + 6), lambda k: embedding[greatest(0, least(63, k)) + 1]::DOUBLE)) / 11) AS sm FROM c)"""


@query("moving_average_nearest", f"{_SMOOTH} SELECT vec_id, i::INT AS node, {r('v', 'y')} FROM (SELECT vec_id, unnest(sm) AS v, unnest(range(0, 64)) AS i FROM s)")
def moving_average_nearest(spark, sf_dir):
    c = D.curves(spark, sf_dir)
    return D.rounded(c.select("vec_id", F.posexplode(A.moving_average_nearest(F.col("y"), 11)).alias("node", "y")))


_PEAK = f"{_SMOOTH}, pk AS (SELECT *, list_position(sm[8:57], list_max(sm[8:57])) + 6 AS peak FROM s)"


@query("peak_landmark", f"{_PEAK} SELECT vec_id, peak::INT AS peak FROM pk")
def peak_landmark(spark, sf_dir):
    lo, hi = A.search_range(D.NODES, 10, 90)
    return D.curves(spark, sf_dir).select("vec_id", A.peak(A.moving_average_nearest(F.col("y"), 11), lo, hi).alias("peak"))


_REGISTERED = f"""{_PEAK}, ref AS (SELECT round_even(median(peak), 0)::DOUBLE AS ref FROM pk),
src AS (SELECT athlete, trial, vec_id, e, unnest(range(0, 64))::INT AS node, peak::DOUBLE AS peak, ref FROM pk, ref),
pos AS (SELECT *, CASE WHEN node <= ref THEN node * peak / ref ELSE peak + (node - ref) * (63 - peak) / (63 - ref) END AS pos FROM src),
lo AS (SELECT *, least(floor(pos), 62)::INT AS lo FROM pos),
reg AS (SELECT athlete, trial, vec_id, node, e[lo + 1]::DOUBLE * (1 - (pos - lo)) + e[lo + 2]::DOUBLE * (pos - lo) AS y FROM lo)"""


@query("peak_registration", f"{_REGISTERED} SELECT vec_id, node, {r('y', 'y')} FROM reg")
def peak_registration(spark, sf_dir):
    reg = influence.register(D.curves(spark, sf_dir).withColumn("landmark", F.col("y")), [], D.NODES)
    return D.rounded(reg.select("vec_id", F.posexplode("warped").alias("node", "y")))


@query(
    "registration_sensitivity",
    f"""{_REGISTERED}, lim AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM c GROUP BY athlete)),
un AS (SELECT 'unregistered' AS rule, athlete, unnest(range(0, 64))::INT AS node, unnest(embedding)::DOUBLE AS y FROM c, lim WHERE trial <= k),
nodes AS (SELECT * FROM un UNION ALL SELECT 'registered', athlete, node, y FROM reg, lim WHERE trial <= k),
cells AS (SELECT rule, athlete, node, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss FROM nodes GROUP BY ALL),
{D.comp_sql('cells', 'rule, node')}
SELECT rule, {r(f'sum(sigma2_b * ({D.WEIGHT}))', 'B', 9)}, {r(f'sum(sigma2_w * ({D.WEIGHT}))', 'W', 9)}, count(*) FILTER (NOT interior) AS boundary_nodes FROM comp GROUP BY rule""",
)
def registration_sensitivity(spark, sf_dir):
    from curvestat.operators import components as C

    reg = influence.register(D.curves(spark, sf_dir).withColumn("landmark", F.col("y")), [], D.NODES)
    both = D._balanced(reg, ["athlete"])
    un = both.select(F.lit("unregistered").alias("rule"), "athlete", "trial", F.posexplode("y").alias("node", "y"))
    warped = both.select(F.lit("registered").alias("rule"), "athlete", "trial", F.posexplode("warped").alias("node", "y"))
    t = C.integrate(C.one_way(un.unionByName(warped), ["rule", "node"]), ["rule"], D.NODES)
    return D.rounded(t.select("rule", "B", "W", "boundary_nodes"), 9)


@query(
    "rolling_display_mean",
    f"{D.ONE_WAY} SELECT node, {r('avg(sigma2_w) OVER (ORDER BY node ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)', 'smooth', 9)} FROM comp",
)
def rolling_display_mean(spark, sf_dir):
    from curvestat.operators import components as C

    c = C.one_way(D.nodes(spark, sf_dir), ["node"]).withColumn("family", F.lit(1))
    return D.rounded(c.select("node", windows.display_mean(c, ["family"], "node", "sigma2_w").alias("smooth")), 9)


@query(
    "observable_prefix",
    f"WITH {D.SEQ_ARRAYS} SELECT user_id, week, least(n, 8)::INT AS observable_rows, greatest(0, 8 - n)::INT AS padding_rows, n > 8 AS nominal_gt, {r('list_sum(xs[1:8])', 'total', 4)} FROM arr",
)
def observable_prefix(spark, sf_dir):
    a = D.sequence_arrays(spark, sf_dir).withColumn("head", A.observable(F.col("xs"), F.size("xs"), 8))
    return D.rounded(a.select("user_id", "week", F.size("head").alias("observable_rows"), F.greatest(F.lit(0), 8 - F.size("xs")).alias("padding_rows"), (F.size("xs") > 8).alias("nominal_gt"), A.total(F.col("head")).alias("total")), 4)


@query("doubled_sequences", f"WITH {D.SEQ_ARRAYS}, x AS (SELECT user_id, week, list_concat(xs, CASE WHEN week % 2 = 0 THEN xs ELSE list_reverse(xs) END) AS two, xs, n FROM arr) SELECT user_id, week, two[1:n] = two[n + 1:2 * n] AS doubled FROM x")
def doubled_sequences(spark, sf_dir):
    a = D.sequence_arrays(spark, sf_dir)
    two = F.concat("xs", F.when(F.col("week") % 2 == 0, F.col("xs")).otherwise(F.reverse("xs")))
    return a.withColumn("two", two).select("user_id", "week", A.doubled(F.col("two"), F.size("xs")).alias("doubled"))


@query(
    "curve_inner_products",
    f"""WITH {D.ALL_NODES}, x AS (SELECT a.athlete, a.trial AS i, b.trial AS j, sum(a.y * b.y * ({D.WEIGHT.replace('node', 'a.node')})) AS g FROM nodes a JOIN nodes b ON a.athlete = b.athlete AND a.node = b.node AND b.trial = a.trial + 1 GROUP BY ALL)
SELECT athlete, i, j, {r('g', 'g')} FROM x""",
)
def curve_inner_products(spark, sf_dir):
    c = D.curves(spark, sf_dir)
    left = c.select("athlete", F.col("trial").cast("bigint").alias("i"), F.col("y").alias("a"))
    right = c.select("athlete", F.col("trial").cast("bigint").alias("j"), F.col("y").alias("b"))
    both = left.join(right.withColumn("i", F.col("j") - 1), ["athlete", "i"])
    return D.rounded(both.select("athlete", "i", "j", A.inner_product(F.col("a"), F.col("b")).alias("g")))
