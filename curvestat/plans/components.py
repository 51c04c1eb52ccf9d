"""Queries of variance components, reliability and trial counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvestat.catalog import CORE
from curvestat.functions import reliability as R
from curvestat.operators import components as C
from curvestat.operators import reml
from curvestat.plans import designs as D
from curvestat.plans.designs import r

query = CORE.query


def comp(spark, sf_dir):
    return C.one_way(D.nodes(spark, sf_dir), ["node"])


def total(spark, sf_dir):
    return C.integrate(comp(spark, sf_dir), [], D.NODES)


@query(
    "oneway_components_embedding",
    f"{D.INTEGRATED} SELECT {r('b', 'B', 9)}, {r('w', 'W', 9)}, boundary_nodes, {r('boundary_nodes / q', 'boundary_fraction', 9)}, {r('b / (b + w / 10)', 'reliability_10', 9)} FROM tot",
)
def oneway_components_embedding(spark, sf_dir):
    t = total(spark, sf_dir)
    return D.rounded(t.select("B", "W", "boundary_nodes", "boundary_fraction", R.reliability(F.col("B"), F.col("W"), F.lit(10.0)).alias("reliability_10")), 9)


@query(
    "oneway_pointwise",
    f"{D.ONE_WAY} SELECT node, p, m, {r('ssb', 'ssb', 9)}, {r('ssw', 'ssw', 9)}, {r('msb', 'msb', 9)}, {r('msw', 'msw', 9)}, interior, {r('sigma2_b', 'sigma2_b', 9)}, {r('sigma2_w', 'sigma2_w', 9)}, "
    f"{r('CASE WHEN sigma2_b + sigma2_w / 10 > 0 THEN sigma2_b / (sigma2_b + sigma2_w / 10) ELSE 0 END', 'reliability_10', 9)} FROM comp",
)
def oneway_pointwise(spark, sf_dir):
    c = comp(spark, sf_dir).withColumn("reliability_10", R.reliability(F.col("sigma2_b"), F.col("sigma2_w"), F.lit(10.0)))
    return D.rounded(c.select("node", "p", "m", "ssb", "ssw", "msb", "msw", "interior", "sigma2_b", "sigma2_w", "reliability_10"), 9)


_GRID = "grid AS (SELECT unnest([1, 2, 5, 10, 15, 20, 30, 40, 50])::INT AS trials_m)"
_POINT = f"sum((CASE WHEN sigma2_b + sigma2_w / trials_m > 0 THEN sigma2_b / (sigma2_b + sigma2_w / trials_m) ELSE 0 END) * ({D.WEIGHT}))"


@query(
    "reliability_dstudy",
    f"{D.INTEGRATED}, {_GRID}, pw AS (SELECT trials_m, {_POINT} AS mp FROM comp, grid GROUP BY trials_m) "
    f"SELECT trials_m, {r('b / (b + w / trials_m)', 'R_L2', 8)}, {r('mp', 'mean_pointwise', 8)} FROM pw, tot",
)
def reliability_dstudy(spark, sf_dir):
    return D.rounded(C.design_study(comp(spark, sf_dir), [], D.NODES), 8)


def _threshold_sql(target: float) -> str:
    return f"greatest(1.0, ceil(nextafter({target} * w / ((1 - {target}) * b), -1.0::DOUBLE)))"


@query(
    "required_trials",
    f"{D.INTEGRATED} SELECT {r('0.8 * w / ((1 - 0.8) * b)', 'continuous_80')}, {r('0.9 * w / ((1 - 0.9) * b)', 'continuous_90')}, {_threshold_sql(0.8)}::DOUBLE AS required_80, {_threshold_sql(0.9)}::DOUBLE AS required_90, "
    "greatest(1.0, ceil(0.9 * w / ((1 - 0.9) * b)))::DOUBLE AS plain_90 FROM tot",
)
def required_trials(spark, sf_dir):
    b, w = F.col("B"), F.col("W")
    t = total(spark, sf_dir).select(
        R.continuous_trials(b, w, 0.8).alias("continuous_80"), R.continuous_trials(b, w, 0.9).alias("continuous_90"),
        R.required_trials(b, w, 0.8).alias("required_80"), R.required_trials(b, w, 0.9).alias("required_90"), R.plain_required_trials(b, w, 0.9).alias("plain_90"),
    )
    return D.rounded(t)


@query(
    "required_trials_pointwise",
    f"""{D.ONE_WAY}, target AS (SELECT unnest([0.1, 0.25, 0.4, 0.9])::DOUBLE AS target),
lim AS (SELECT sum(CASE WHEN sigma2_b > 0 THEN ({D.WEIGHT}) ELSE 0 END) AS top FROM comp),
cand AS (SELECT unnest(range(1, 4001))::INT AS trials_m), pw AS (SELECT trials_m, {_POINT} AS mp FROM comp, cand GROUP BY trials_m)
SELECT target, coalesce(min(trials_m) FILTER (mp >= target AND top + 1e-14 >= target), 'Infinity'::DOUBLE)::DOUBLE AS required FROM target, pw, lim GROUP BY target""",
)
def required_trials_pointwise(spark, sf_dir):
    shaped = C.component_arrays(comp(spark, sf_dir), []).filter(F.size("bs") > 0)
    out = None
    for t in (0.1, 0.25, 0.4, 0.9):
        one = shaped.select(F.lit(t).alias("target"), R.required_pointwise(F.col("bs"), F.col("ws"), t).alias("required"))
        out = one if out is None else out.unionByName(one)
    return out


def _summary_sql() -> str:
    points = ", ".join(f"max(mp) FILTER (trials_m = {n}) AS mp{n}" for n in R.GRID)
    columns = ", ".join(f"{r(f'b / (b + w / {n}.0)', f'R_L2_m{n}', 8)}, {r(f'mp{n}', f'mean_pointwise_reliability_m{n}', 8)}" for n in R.GRID)
    return f"{D.INTEGRATED}, {_GRID}, pw AS (SELECT trials_m, {_POINT} AS mp FROM comp, grid GROUP BY trials_m), wide AS (SELECT {points} FROM pw) SELECT {r('b', 'B', 9)}, {r('w', 'W', 9)}, boundary_nodes, {r('boundary_nodes / q', 'boundary_fraction', 9)}, {columns} FROM tot, wide"


@query("component_summary", _summary_sql())
def component_summary(spark, sf_dir):
    s = C.component_summary(comp(spark, sf_dir), [], D.NODES)
    return D.rounded(s.select(*[c for c in s.columns if not c.startswith("required")]), 8, B=9, W=9, boundary_fraction=9)


_TWO = """WITH c AS (SELECT label AS athlete, (vec_id % 3)::INT AS action, vec_id, row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) AS trial, embedding FROM embeddings),
bal AS (SELECT * FROM c WHERE trial <= (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY athlete, action))),
nodes AS (SELECT athlete, action, trial, unnest(range(0, 64))::INT AS node, unnest(embedding)::DOUBLE AS y FROM bal),
cells AS (SELECT node, athlete, action, avg(y) AS m, var_pop(y) * count(*) AS ss, count(*) AS r FROM nodes GROUP BY ALL),
ath AS (SELECT node, athlete, avg(m) AS m FROM cells GROUP BY ALL), act AS (SELECT node, action, avg(m) AS m FROM cells GROUP BY ALL),
g AS (SELECT node, avg(m) AS m, sum(ss) AS sse, min(r) AS r FROM cells GROUP BY ALL),
sp AS (SELECT node, count(*) AS p, sum((ath.m - g.m) ^ 2) AS v FROM ath JOIN g USING (node) GROUP BY ALL),
sa AS (SELECT node, count(*) AS a, sum((act.m - g.m) ^ 2) AS v FROM act JOIN g USING (node) GROUP BY ALL),
si AS (SELECT node, sum((cells.m - ath.m - act.m + g.m) ^ 2) AS v FROM cells JOIN ath USING (node, athlete) JOIN act USING (node, action) JOIN g USING (node) GROUP BY ALL),
ms AS (SELECT node, p, a, r, a * r * sp.v / (p - 1) AS msp, p * r * sa.v / (a - 1) AS msa, r * si.v / ((p - 1) * (a - 1)) AS msi, sse / (p * a * (r - 1)) AS mse FROM sp JOIN sa USING (node) JOIN si USING (node) JOIN g USING (node)),
raw AS (SELECT node, p, a, r, (msa - msi) / (p * r) AS ra, (msp - msi) / (a * r) AS rp, (msi - mse) / r AS ri, mse AS re FROM ms),
tw AS (SELECT *, greatest(ra, 0) AS va, greatest(rp, 0) AS vp, greatest(ri, 0) AS vi, greatest(re, 0) AS ve FROM raw)"""
_NAMES = {"action": "a", "athlete": "p", "action_athlete": "i", "residual": "e"}


def two_way(spark, sf_dir):
    return C.two_way(D.action_nodes(spark, sf_dir), ["node"])


@query("twoway_components", f"{_TWO} SELECT node, p, a, r, " + ", ".join(f"{r('r' + s, 'raw_' + k, 9)}, {r('v' + s, 'sigma2_' + k, 9)}" for k, s in _NAMES.items()) + " FROM tw")
def twoway_components(spark, sf_dir):
    return D.rounded(two_way(spark, sf_dir), 9)


@query("twoway_pointwise", f"{_TWO} SELECT node, " + ", ".join(r(f"CASE WHEN va + vp + vi + ve > 0 THEN v{s} / (va + vp + vi + ve) ELSE 0 END", f"omega_{k}", 7) for k, s in _NAMES.items()) + " FROM tw")
def twoway_pointwise(spark, sf_dir):
    return D.rounded(C.two_way_pointwise(two_way(spark, sf_dir)).select("node", *[f"omega_{k}" for k in C.PARTS]), 7)


_GLOBAL = f"{_TWO}, i AS (SELECT " + ", ".join(f"sum(v{s} * ({D.WEIGHT})) AS {s}" for s in "apie") + " FROM tw)"
_CONTEXT = {
    "athlete_across_actions": "CASE WHEN p > 0 THEN p / (p + i / 6 + e / (6 * {n})) ELSE 0 END",
    "all_cells": "CASE WHEN a + p + i + e / {n} > 0 THEN (a + p + i) / (a + p + i + e / {n}) ELSE 0 END",
    "pooled_fixed_actions": "CASE WHEN p + i + e / {n} > 0 THEN (p + i) / (p + i + e / {n}) ELSE 0 END",
}


@query(
    "twoway_shares",
    f"{_GLOBAL} SELECT " + ", ".join(f"{r(s, 'I_' + k, 9)}, {r(f'{s} / (a + p + i + e)', 'omega_' + k, 7)}" for k, s in _NAMES.items()) + ", " + ", ".join(r(v.format(n="50.0"), f"context_{k}_n50", 7) for k, v in _CONTEXT.items()) + " FROM i",
)
def twoway_shares(spark, sf_dir):
    return D.rounded(C.global_summary(two_way(spark, sf_dir), [], D.NODES), 7, **{f"I_{k}": 9 for k in C.PARTS})


@query("global_dstudy", f"{_GLOBAL}, {_GRID} SELECT trials_m AS trials_per_cell, " + ", ".join(r(v.format(n="trials_m"), k, 7) for k, v in _CONTEXT.items()) + " FROM i, grid")
def global_dstudy(spark, sf_dir):
    return D.rounded(C.global_design_study(C.global_summary(two_way(spark, sf_dir), [], D.NODES)), 7)


_STATS = "stats AS (SELECT athlete, node, count(*) AS n, sum(y) AS s, sum(y * y) AS z FROM nodes GROUP BY ALL)"


@query("unbalanced_sufficient", f"WITH {D.ALL_NODES}, {_STATS} SELECT athlete, node, n, {r('s', 's')}, {r('z', 'z')} FROM stats")
def unbalanced_sufficient(spark, sf_dir):
    return D.rounded(reml.sufficient(D.to_nodes(D.curves(spark, sf_dir)), ["node"]))


@query(
    "profile_objective_grid",
    f"""WITH {D.ALL_NODES}, {_STATS}, l AS (SELECT unnest([0.0, 0.001, 0.01, 0.1, 1.0])::DOUBLE AS lam),
x AS (SELECT node, lam, sum(n / (1 + n * lam)) AS a, sum(s / (1 + n * lam)) AS b, sum(z - lam * s * s / (1 + n * lam)) AS q0, sum(ln(1 + n * lam)) AS logs, sum(n) - 1 AS df FROM stats, l GROUP BY ALL),
y AS (SELECT *, greatest(q0 - b * b / a, 2.2250738585072014e-308) AS q FROM x)
SELECT node, lam, {r('df * ln(q / df) + logs + ln(a)', 'objective')}, {r('b / a', 'gls_mean', 8)} FROM y""",
)
def profile_objective_grid(spark, sf_dir):
    stats = reml.sufficient(D.to_nodes(D.curves(spark, sf_dir)), ["node"])
    lams = C.grid(spark, [0.0, 0.001, 0.01, 0.1, 1.0], "lam")
    out = reml.objective(stats.crossJoin(F.broadcast(lams)), ["node", "lam"], F.col("lam"))
    return D.rounded(out.select("node", "lam", "objective", "gls_mean"), 6, gls_mean=8)


def reml_sql(stats: str, stages: int = 9) -> str:
    """CTEs ending in ``fit``: the profile objective of stats (node, athlete, n, s, z) on 81 points, then on ever finer grids around the best one."""

    def at(points: str) -> str:
        l = "exp(p.th)"  # noqa: E741
        return f"""(SELECT node, th, df, q, df * ln(q / df) + logs + ln(a) AS f FROM (SELECT node, th, df, logs, a, greatest(q0 - b * b / a, 2.2250738585072014e-308) AS q FROM
 (SELECT p.node, p.th, sum(n) - 1 AS df, sum(n / (1 + n * {l})) AS a, sum(s / (1 + n * {l})) AS b, sum(z - {l} * s * s / (1 + n * {l})) AS q0, sum(ln(1 + n * {l})) AS logs FROM {points} p JOIN {stats} USING (node) GROUP BY p.node, p.th)))"""

    parts = [
        f"g0 AS (SELECT node, th FROM (SELECT DISTINCT node FROM {stats}), (SELECT unnest(range(0, 81)) * 0.5::DOUBLE - 20 AS th))",
        f"r0 AS (SELECT node, CASE WHEN th = -20 THEN -32 ELSE th - 0.5 END AS lo, CASE WHEN th = 20 THEN 32 ELSE th + 0.5 END AS hi FROM (SELECT node, arg_min(th, f) AS th FROM {at('g0')} GROUP BY node))",
    ]
    for i in range(1, stages + 1):
        parts.append(f"g{i} AS (SELECT node, lo + (hi - lo) * k / 20 AS th FROM r{i - 1}, (SELECT unnest(range(0, 21))::DOUBLE AS k))")
        parts.append(f"r{i} AS (SELECT node, greatest(lo, th - (hi - lo) / 20) AS lo, least(hi, th + (hi - lo) / 20) AS hi FROM (SELECT node, arg_min(th, f) AS th FROM {at(f'g{i}')} GROUP BY node) JOIN r{i - 1} USING (node))")
    parts.append(f"best AS (SELECT node, (lo + hi) / 2 AS th FROM r{stages})")
    # exp(-800) is 0: the objective without any between component
    parts.append("none AS (SELECT node, -800.0::DOUBLE AS th FROM best)")
    parts.append(f"fit AS (SELECT b.node, z.f > b.f + 1e-11 * (1 + abs(b.f)) AS interior, b.th > 31.5 AS upper_warning, isfinite(b.f) AS converged, CASE WHEN z.f > b.f + 1e-11 * (1 + abs(b.f)) THEN exp(b.th) ELSE 0 END AS lam, CASE WHEN z.f > b.f + 1e-11 * (1 + abs(b.f)) THEN b.q ELSE z.q END / b.df AS sigma2_w FROM {at('best')} b JOIN {at('none')} z USING (node))")
    return ",\n".join(parts)


#: Integrated components of a fit, and the thresholds and reliabilities that queries take from them.
_FIT_TOTAL = f"ft AS (SELECT sum(lam * sigma2_w * ({D.WEIGHT})) AS b, sum(sigma2_w * ({D.WEIGHT})) AS w, count(*) FILTER (NOT interior) AS boundary_nodes FROM fit)"


def _trials(target: float) -> str:
    return f"CASE WHEN b > 0 THEN greatest(1.0, ceil({target} * w / ((1 - {target}) * b) * 0.9999999999999999)) ELSE 'Infinity'::DOUBLE END"


@query("unbalanced_reml", f"WITH {D.ALL_NODES}, {_STATS}, {reml_sql('stats')} SELECT node, {r('lam * sigma2_w', 'sigma2_b', 5)}, {r('sigma2_w', 'sigma2_w', 5)}, {r('lam', 'lam', 4)}, interior, converged, upper_warning FROM fit")
def unbalanced_reml(spark, sf_dir):
    fit = reml.unbalanced(reml.sufficient(D.to_nodes(D.curves(spark, sf_dir)), ["node"]), ["node"])
    return D.rounded(fit, 5, lam=4)


@query(
    "unbalanced_reml_on_balanced",
    f"{D.ONE_WAY} SELECT node, {r('sigma2_b', 'sigma2_b')}, {r('sigma2_w', 'sigma2_w')} FROM comp",
)
def unbalanced_reml_on_balanced(spark, sf_dir):
    """On a balanced design the profile fit and the closed form agree."""
    fit = reml.unbalanced(reml.sufficient(D.nodes(spark, sf_dir), ["node"]), ["node"])
    return D.rounded(fit.select("node", "sigma2_b", "sigma2_w"))


@query(
    "keep_mask_fit",
    f"WITH {D.CURVES}, nodes AS (SELECT athlete, trial, unnest(range(0, 64))::INT AS node, unnest(embedding)::DOUBLE AS y FROM c WHERE list_max(embedding) <= 0.35), {_STATS}, {reml_sql('stats')}, {_FIT_TOTAL} "
    f"SELECT {r('b', 'B')}, {r('w', 'W')}, boundary_nodes, {', '.join(f'{_trials(t)} AS required_{round(100 * t)}' for t in R.TARGETS)} FROM ft",
)
def keep_mask_fit(spark, sf_dir):
    """Fit of the trials that a keep predicate leaves; thresholds from the integrated components."""
    c = D.curves(spark, sf_dir).withColumn("keep", F.array_max("y") <= 0.35).filter("keep")
    fit = reml.unbalanced(reml.sufficient(D.to_nodes(c), ["node"]), ["node"])
    t = C.integrate(fit, [], D.NODES)
    return D.rounded(t.select("B", "W", "boundary_nodes", *[R.required_trials(F.col("B"), F.col("W"), x).alias(f"required_{round(100 * x)}") for x in R.TARGETS]))


_ITEM = """li AS (SELECT l_suppkey AS athlete, l_returnflag AS action, l_quantity AS y, l_shipdate, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS trial FROM lineitem)"""


@query(
    "exclusion_counts",
    f"""WITH {_ITEM}, per AS (SELECT action, athlete, count(*) AS n, count(*) FILTER (y <= 45) AS kept FROM li GROUP BY ALL)
SELECT action, sum(n)::BIGINT AS original, sum(n - kept)::BIGINT AS excluded, sum(kept)::BIGINT AS retained, {r('100.0 * sum(kept) / sum(n)', 'retained_percent')}, min(kept) AS min_kept, {r('median(kept)', 'median_kept')}, max(kept) AS max_kept, {r('avg(kept)', 'mean_kept')} FROM per GROUP BY action""",
)
def exclusion_counts(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("athlete"), F.col("l_returnflag").alias("action"), F.col("l_quantity").alias("y"))
    per = li.groupBy("action", "athlete").agg(F.count("*").alias("n"), F.count_if(F.col("y") <= 45).alias("kept"))
    out = per.groupBy("action").agg(
        F.sum("n").alias("original"), F.sum(F.col("n") - F.col("kept")).alias("excluded"), F.sum("kept").alias("retained"), (100.0 * F.sum("kept") / F.sum("n")).alias("retained_percent"),
        F.min("kept").alias("min_kept"), F.median("kept").alias("median_kept"), F.max("kept").alias("max_kept"), F.avg("kept").alias("mean_kept"),
    )
    return D.rounded(out)


@query(
    "oneway_components_lineitem",
    f"""WITH {_ITEM}, lim AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM li GROUP BY athlete, action)),
cells AS (SELECT action, athlete, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss FROM li, lim WHERE trial <= k GROUP BY ALL),
{D.comp_sql('cells', 'action')} SELECT action, p, m, {r('msb', 'msb')}, {r('msw', 'msw')}, interior, {r('sigma2_b', 'sigma2_b')}, {r('sigma2_w', 'sigma2_w')} FROM comp""",
)
def oneway_components_lineitem(spark, sf_dir):
    from curvestat.operators.windows import trial_rank

    li = D.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("athlete"), F.col("l_returnflag").alias("action"), F.col("l_quantity").alias("y"), "l_orderkey", "l_linenumber")
    kept = D._balanced(trial_rank(li, ["athlete", "action"], ["l_orderkey", "l_linenumber"]), ["athlete", "action"])
    out = C.one_way(kept, ["action"])
    return D.rounded(out.select("action", "p", "m", "msb", "msw", "interior", "sigma2_b", "sigma2_w"))


@query("reliability_curve_grid", f"{D.INTEGRATED}, n AS (SELECT unnest(range(1, 51))::INT AS trials) SELECT trials, {r('b / (b + w / trials)', 'R_L2', 9)} FROM tot, n")
def reliability_curve_grid(spark, sf_dir):
    """Reliability of 1 to 50 trials, as drawn in curves of R(n)."""
    t = total(spark, sf_dir).crossJoin(F.broadcast(C.grid(spark, list(range(1, 51)), "trials")))
    return D.rounded(t.select("trials", R.reliability(F.col("B"), F.col("W"), F.col("trials").cast("double")).alias("R_L2")), 9)


@query(
    "complete_case_fit",
    f"WITH {D.JOINTS_SQL}, broken AS (SELECT DISTINCT trial AS athlete, frame + 1 AS trial FROM zj WHERE zero), nodes AS (SELECT athlete, trial, unnest(range(0, 64))::INT AS node, unnest(embedding)::DOUBLE AS y FROM c ANTI JOIN broken USING (athlete, trial)), {_STATS}, {reml_sql('stats')}, {_FIT_TOTAL} "
    f"SELECT {r('b', 'B')}, {r('w', 'W')}, boundary_nodes, {', '.join(r(f'CASE WHEN b + w / {n} > 0 THEN b / (b + w / {n}.0) ELSE 0 END', f'R_L2_m{n}', 5) for n in (1, 5, 10, 50))}, {', '.join(f'{_trials(t)} AS required_n_R_L2_{round(100 * t)}' for t in R.TARGETS)} FROM ft",
)
def complete_case_fit(spark, sf_dir):
    """Unbalanced fit of trials without a missing joint, with thresholds and reliabilities of 1, 5, 10 and 50 trials."""
    from curvestat.operators.curve_audit import is_zero

    broken = D.joints(spark, sf_dir).filter(is_zero()).select(F.col("trial").alias("athlete"), (F.col("frame") + 1).alias("trial")).distinct()
    complete = D.curves(spark, sf_dir).join(broken, ["athlete", "trial"], "left_anti")
    fit = reml.unbalanced(reml.sufficient(D.to_nodes(complete), ["node"]), ["node"])
    b, w = F.col("B"), F.col("W")
    t = C.integrate(fit, [], D.NODES)
    reliabilities = [R.reliability(b, w, F.lit(float(n))).alias(f"R_L2_m{n}") for n in (1, 5, 10, 50)]
    out = t.select("B", "W", "boundary_nodes", *reliabilities, *[R.required_trials(b, w, x).alias(f"required_n_R_L2_{round(100 * x)}") for x in R.TARGETS])
    return D.rounded(out, 5, B=6, W=6)


_COPIES = """c0 AS (SELECT label AS athlete, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS trial, embedding FROM embeddings),
c1 AS (SELECT * FROM c0 UNION ALL SELECT (athlete + 3) % 10, vec_id + 1000000, trial + 10000, embedding FROM c0 WHERE vec_id % 20 = 0),
m AS (SELECT vec_id, row_number() OVER (PARTITION BY embedding ORDER BY athlete DESC, vec_id DESC) AS place, count(*) OVER (PARTITION BY embedding) AS n FROM c1),
c AS (SELECT * FROM c1 WHERE vec_id NOT IN (SELECT vec_id FROM m WHERE n > 1 AND place = 1))"""


@query(
    "deduplicated_unbalanced_fit",
    f"WITH {_COPIES}, nodes AS (SELECT athlete, trial, unnest(range(0, 64))::INT AS node, unnest(embedding)::DOUBLE AS y FROM c), {_STATS}, {reml_sql('stats')}, {_FIT_TOTAL} SELECT {r('b', 'B')}, {r('w', 'W')}, boundary_nodes FROM ft",
)
def deduplicated_unbalanced_fit(spark, sf_dir):
    """Unbalanced fit after one member of each group of equal curves is removed; every twentieth curve also stands under another athlete."""
    from curvestat.functions.arrays import digest
    from curvestat.operators import influence

    one = D.curves(spark, sf_dir)
    copies = one.filter(F.col("vec_id") % 20 == 0).select(((F.col("athlete") + 3) % 10).cast(one.schema["athlete"].dataType).alias("athlete"), (F.col("vec_id") + 1000000).alias("vec_id"), "y", (F.col("trial") + 10000).alias("trial"))
    c = one.unionByName(copies).withColumn("sha", digest(F.col("y")))
    members = influence.duplicate_groups(c.select("sha", "athlete", "vec_id"), "sha")
    removed = influence.duplicate_removals(members, "athlete", "vec_id", 8).select("vec_id")
    fit = reml.unbalanced(reml.sufficient(D.to_nodes(c.join(removed, "vec_id", "left_anti")), ["node"]), ["node"])
    return D.rounded(C.integrate(fit, [], D.NODES).select("B", "W", "boundary_nodes"))


@query("too_small_groups", "SELECT label AS athlete, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) < 50")
def too_small_groups(spark, sf_dir):
    stats = D.curves(spark, sf_dir).groupBy("athlete").agg(F.count("*").alias("n"))
    return reml.too_small(stats, 50)
