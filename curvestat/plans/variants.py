"""Queries of the array variants: curves, fits and influence under every rule for joints and high values.

The design: a label's vectors in their order are frames of 14 joints, six frames a trial; joints outside the
fixed eight lose some triplets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curvestat.catalog import CORE
from curvestat.functions import reliability as R
from curvestat.operators import components as C
from curvestat.operators import curve_audit
from curvestat.operators import variants as V
from curvestat.operators.lineage import cut
from curvestat.plans import designs as D
from curvestat.plans.designs import r
from curvestat.schema import VARIANTS

query = CORE.query
FRAMES, NODES = 6, 16
#: Cuts at which curves of five intervals have high values.
Z, RATIO = 2.0, 1.02
_MAY_BE_LOST = tuple(j for j in range(1, 15) if j not in VARIANTS["fixed8"][0])


def frames(spark, sf_dir):
    """athlete, trial, frame, joint, x, y, z; as many whole trials of each athlete as the one with fewest frames has."""
    c = D.curves(spark, sf_dir)
    least = c.groupBy("athlete").agg(F.count("*").alias("n")).agg(F.floor(F.min("n") / FRAMES).alias("trials"))
    at = F.col("trial") - 1
    placed = c.select("athlete", F.floor(at / FRAMES).alias("trial"), (at % FRAMES).alias("frame"), "vec_id", "y")
    whole = placed.join(F.broadcast(least), F.col("trial") < F.col("trials")).drop("trials")
    flat = curve_audit.to_joints(whole, ["athlete", "trial", "frame", "vec_id"], "y", D.JOINTS)
    lost = F.col("joint").isin(*_MAY_BE_LOST) & ((F.col("vec_id") + F.col("joint")) % 17 == 0)
    return flat.select("athlete", "trial", "frame", "joint", *[F.when(lost, 0.0).otherwise(F.col(x)).alias(x) for x in ("x", "y", "z")])


def steps(spark, sf_dir):
    return V.body_steps(frames(spark, sf_dir), ["athlete", "trial"])


def curves(spark, sf_dir):
    return V.curves(steps(spark, sf_dir), NODES, z=Z, ratio=RATIO)


def cells(spark, sf_dir):
    return V.cells(curves(spark, sf_dir))


def _steps_sql() -> str:
    means = ", ".join(f"avg(moved) FILTER (valid AND joint IN {chosen}) AS x_{name}, count(*) FILTER (valid AND joint IN {chosen}) AS n_{name}" for name, (chosen, _) in VARIANTS.items())
    each = " UNION ALL ".join(f"SELECT athlete, trial, '{name}' AS variant, list(x_{name} ORDER BY step) AS xs, min(n_{name}) AS fewest, {least} AS least FROM body GROUP BY ALL" for name, (_, least) in VARIANTS.items())
    return f"""WITH {D.CURVES}, lim AS (SELECT min(n) // {FRAMES} AS trials FROM (SELECT count(*) AS n FROM c GROUP BY athlete)),
f AS (SELECT athlete, (trial - 1) // {FRAMES} AS trial, (trial - 1) % {FRAMES} AS frame, vec_id, embedding, unnest(range(1, 15))::INT AS joint FROM c, lim WHERE (trial - 1) // {FRAMES} < trials),
j AS (SELECT athlete, trial, frame, joint, CASE WHEN joint IN {_MAY_BE_LOST} AND (vec_id + joint) % 17 = 0 THEN [0.0, 0.0, 0.0]::DOUBLE[] ELSE embedding[3 * joint - 2 : 3 * joint]::DOUBLE[] END AS v FROM f),
l AS (SELECT *, lag(v) OVER (PARTITION BY athlete, trial, joint ORDER BY frame) AS pv FROM j),
s AS (SELECT athlete, trial, joint, frame - 1 AS step, list_distance(v, pv) AS moved, list_sum(list_transform(v, lambda x: abs(x))) > 0 AND list_sum(list_transform(pv, lambda x: abs(x))) > 0 AS valid FROM l WHERE pv IS NOT NULL),
body AS (SELECT athlete, trial, step, {means} FROM s GROUP BY ALL), st AS ({each})"""


def _curves_sql() -> str:
    eps = "2.220446049250313e-16"
    return f"""{_steps_sql()},
near AS (SELECT *, unnest(range(0, len(xs)))::INT AS i FROM st WHERE variant = 'all14' AND fewest >= least),
around AS (SELECT *, list_concat(xs[greatest(i - 5, 0) + 1 : i], xs[i + 2 : i + 6]) AS a FROM near),
md AS (SELECT *, list_median(a) AS m FROM around), mad AS (SELECT *, list_median(list_transform(a, lambda v: abs(v - m))) AS d FROM md),
fl AS (SELECT athlete, trial, xs, i, len(a) >= 4 AND xs[i + 1] > greatest(m + {Z} * greatest(1.4826 * d, {eps}), {RATIO} * greatest(m, {eps})) AS flag FROM mad),
nb AS (SELECT *, max(CASE WHEN NOT flag THEN i END) OVER (PARTITION BY athlete, trial ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
 min(CASE WHEN NOT flag THEN i END) OVER (PARTITION BY athlete, trial ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM fl),
rep AS (SELECT athlete, trial, 'hampel' AS variant, list(CASE WHEN NOT flag THEN xs[i + 1] WHEN lo IS NULL THEN xs[hi + 1] WHEN hi IS NULL THEN xs[lo + 1] ELSE xs[lo + 1] + (xs[hi + 1] - xs[lo + 1]) * (i - lo) / (hi - lo) END ORDER BY i) AS xs,
 count(*) FILTER (flag) AS flagged FROM nb GROUP BY athlete, trial HAVING count(*) FILTER (NOT flag) >= 2),
every AS (SELECT athlete, trial, variant, xs, NULL AS flagged FROM st WHERE fewest >= least UNION ALL SELECT athlete, trial, variant, xs, flagged FROM rep),
pos AS (SELECT *, unnest(range(0, {NODES}))::INT AS node FROM every), g AS (SELECT *, node * (len(xs) - 1) / {NODES - 1}.0::DOUBLE AS p FROM pos),
pt AS (SELECT variant, athlete, trial, node, flagged, xs[least(floor(p)::INT, len(xs) - 2) + 1] * (1 - (p - least(floor(p)::INT, len(xs) - 2))) + xs[least(floor(p)::INT, len(xs) - 2) + 2] * (p - least(floor(p)::INT, len(xs) - 2)) AS y FROM g)"""


@query("variant_curves", f"{_curves_sql()} SELECT variant, athlete, trial, node, flagged, {r('y', 'y')} FROM pt")
def variant_curves(spark, sf_dir):
    """Normalised body curves of all four variants, with the number of high values that the hampel variant repaired."""
    flagged = F.size(F.filter("flags", lambda x: x)).cast("bigint")
    return D.rounded(curves(spark, sf_dir).select("variant", "athlete", "trial", F.when(F.col("flags").isNotNull(), flagged).alias("flagged"), F.posexplode("y").alias("node", "y")))


@query("variant_fewest_joints", f"{_steps_sql()} SELECT variant, min(fewest) AS fewest, count(*) FILTER (fewest < least) AS short_trials, count(*) AS trials FROM st GROUP BY ALL")
def variant_fewest_joints(spark, sf_dir):
    """Fewest usable joints of each variant, and trials that have too few; there may be none."""
    s = steps(spark, sf_dir)
    least = V.short_of_joints(s).select("athlete", "trial", "variant", F.lit(1).alias("short"))
    return s.join(least, ["athlete", "trial", "variant"], "left").groupBy("variant").agg(F.min("fewest").alias("fewest"), F.count("short").alias("short_trials"), F.count("*").alias("trials"))


_WEIGHT = f"CASE WHEN node IN (0, {NODES - 1}) THEN 0.5 / {NODES - 1} ELSE 1.0 / {NODES - 1} END"
_CELLS = f"{_curves_sql()}, vc AS (SELECT variant, athlete, node, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss FROM pt GROUP BY ALL)"
_TRACE = lambda t: f"CASE WHEN b > 0 THEN greatest(1.0, ceil({t} * w / ((1 - {t}) * b) * 0.9999999999999999)) ELSE 'Infinity'::DOUBLE END"
_COLUMNS = "boundary_nodes, " + ", ".join([r("b", "B", 9), r("w", "W", 9), *[r(f"CASE WHEN b + w / {n} > 0 THEN b / (b + w / {n}) ELSE 0 END", f"R_L2_m{n}", 7) for n in R.GRID], *[f"{_TRACE(t)} AS required_n_R_L2_{round(100 * t)}" for t in R.TARGETS]])
_TOTAL = f"sum(sigma2_b * ({_WEIGHT})) AS b, sum(sigma2_w * ({_WEIGHT})) AS w, count(*) FILTER (NOT interior) AS boundary_nodes"
_KEPT = ["boundary_nodes", "B", "W", *[f"R_L2_m{n}" for n in R.GRID], *[f"required_n_R_L2_{round(100 * t)}" for t in R.TARGETS]]


def _kept(summary, *keys):
    return D.rounded(summary.select(*keys, *_KEPT), 7, B=9, W=9)


@query("variant_fits", f"{_CELLS}, {D.comp_sql('vc', 'variant, node')}, t AS (SELECT variant, {_TOTAL} FROM comp GROUP BY variant) SELECT variant, {_COLUMNS} FROM t")
def variant_fits(spark, sf_dir):
    """The same estimators on every variant."""
    return _kept(V.fits(cells(spark, sf_dir), NODES), "variant")


_RULED = "ru AS (SELECT CASE variant " + " ".join(f"WHEN '{name}' THEN '{rule}'" for rule, name in V.RULES.items()) + f" END AS quality_rule, * FROM vc WHERE variant IN {tuple(V.RULES.values())})"


@query(
    "loo_quality_rules",
    f"{_CELLS}, {_RULED}, lc AS (SELECT ex.athlete AS excluded, ru.* FROM ru JOIN (SELECT DISTINCT quality_rule, athlete FROM ru) ex ON ex.quality_rule = ru.quality_rule AND ex.athlete <> ru.athlete), {D.comp_sql('lc', 'quality_rule, excluded, node')}, t AS (SELECT quality_rule, excluded, {_TOTAL} FROM comp GROUP BY ALL) SELECT quality_rule, excluded, {_COLUMNS} FROM t",
)
def loo_quality_rules(spark, sf_dir):
    """Fits without each athlete under both quality rules."""
    return _kept(V.leave_one_out(cut(cells(spark, sf_dir)), NODES), "quality_rule", "excluded")


@query(
    "contribution_quality_rules",
    f"""{_CELLS}, {_RULED}, gr AS (SELECT *, avg(mean) OVER (PARTITION BY quality_rule, node) AS gm FROM ru),
t AS (SELECT quality_rule, athlete, sum(({_WEIGHT}) * ss) AS a, sum(({_WEIGHT}) * (mean - gm) ^ 2) AS b FROM gr GROUP BY ALL)
SELECT quality_rule, athlete, {r('a / sum(a) OVER (PARTITION BY quality_rule)', 'within_share', 8)}, {r('b / sum(b) OVER (PARTITION BY quality_rule)', 'deviation_share', 8)} FROM t""",
)
def contribution_quality_rules(spark, sf_dir):
    """Shares of each athlete in both sums of squares under both quality rules."""
    c = V.contributions(cut(cells(spark, sf_dir)), NODES)
    return D.rounded(c.select("quality_rule", "athlete", "within_share", "deviation_share"), 8)
