"""Queries of bootstrap, subsampling, dependence and influence."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvestat.catalog import CORE
from curvestat.functions.arrays import node_weight
from curvestat.functions import reliability as R
from curvestat.functions.distributions import quantile_error
from curvestat.operators import components as C
from curvestat.operators import dependence, influence, resampling
from curvestat.operators import replicates as replicates_of
from curvestat.plans import designs as D
from curvestat.plans.designs import r

query = CORE.query
#: The reference's counts of replicates, permutations and subsamples.
REPS, PERMUTATIONS, SUBSAMPLES, SEED = 5000, 5000, 1000, 11


def _hash(*parts: str) -> str:
    text = " || '|' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


DRAWS = f"""grp AS (SELECT athlete, row_number() OVER (ORDER BY athlete) - 1 AS pos FROM (SELECT DISTINCT label AS athlete FROM embeddings)),
k AS (SELECT count(*) AS k FROM grp),
picks AS (SELECT rep, d, {_hash(str(SEED), 'rep', 'd')} % k AS pos FROM (SELECT unnest(range(1, {REPS + 1}))::INT AS rep), k, (SELECT unnest(range(0, (SELECT k FROM k))) AS d)),
draws AS (SELECT rep, athlete, count(*) AS cnt FROM picks JOIN grp USING (pos) GROUP BY ALL)"""
BOOT = f"""WITH {D.NODES_SQL}, {D.CELLS}, {DRAWS},
bs AS (SELECT rep, node, sum(cnt)::BIGINT AS p, min(n) AS m, min(n) * greatest(sum(cnt * mean * mean) - sum(cnt * mean) ^ 2 / sum(cnt), 0) AS ssb, sum(cnt * ss) AS ssw FROM cells JOIN draws USING (athlete) GROUP BY ALL),
bm AS (SELECT *, ssb / (p - 1) AS msb, ssw / (p * (m - 1)) AS msw FROM bs),
bc AS (SELECT *, msb >= msw AS interior, CASE WHEN msb >= msw THEN (msb - msw) / m ELSE 0 END AS sigma2_b, CASE WHEN msb >= msw THEN msw ELSE (ssb + ssw) / (p * m - 1) END AS sigma2_w FROM bm),
bt AS (SELECT rep, sum(sigma2_b * ({D.WEIGHT})) AS b, sum(sigma2_w * ({D.WEIGHT})) AS w, count(*) FILTER (NOT interior) AS boundary_nodes FROM bc GROUP BY rep),
n90 AS (SELECT *, CASE WHEN b > 0 THEN 0.9 * w / ((1 - 0.9) * b) ELSE 'Infinity'::DOUBLE END AS n90, CASE WHEN b > 0 THEN b / (b + w / 10) ELSE 0 END AS r10 FROM bt)"""


def cells(spark, sf_dir):
    return C.cell_statistics(D.nodes(spark, sf_dir), ["node"])


def drawn(spark, sf_dir, reps=REPS):
    return resampling.draws(spark, reps, D.curves(spark, sf_dir).select("athlete"), SEED)


def replicates(spark, sf_dir, reps=REPS):
    """rep, B, W, boundary_nodes, n90, r10 of each replicate."""
    boot = resampling.bootstrap_components(cells(spark, sf_dir), drawn(spark, sf_dir, reps), ["node"])
    t = C.integrate(boot, ["rep"], D.NODES)
    return t.select("rep", "B", "W", "boundary_nodes", R.continuous_trials(F.col("B"), F.col("W"), 0.9).alias("n90"), R.reliability(F.col("B"), F.col("W"), F.lit(10.0)).alias("r10"))


@query("bootstrap_draws", f"WITH {DRAWS} SELECT rep, athlete, cnt FROM draws")
def bootstrap_draws(spark, sf_dir):
    return drawn(spark, sf_dir).select("rep", "athlete", "cnt")


@query("cluster_bootstrap_components", f"{BOOT} SELECT rep, {r('b', 'B', 8)}, {r('w', 'W', 8)}, boundary_nodes, {r('r10', 'r10', 7)} FROM n90")
def cluster_bootstrap_components(spark, sf_dir):
    return D.rounded(replicates(spark, sf_dir).select("rep", "B", "W", "boundary_nodes", "r10"), 8, r10=7)


_METRICS = ("B", "W", "r10", "n90")


@query(
    "bootstrap_percentiles",
    f"""{BOOT}, long AS (SELECT 'B' AS metric, b AS v FROM n90 UNION ALL SELECT 'W', w FROM n90 UNION ALL SELECT 'r10', r10 FROM n90 UNION ALL SELECT 'n90', n90 FROM n90),
f AS (SELECT metric, v, isfinite(v) AS fin FROM long)
SELECT metric, count(*) AS replicates, count(*) FILTER (fin) AS finite_replicates, {r('avg(v) FILTER (fin)', 'mean', 5)}, {r('coalesce(stddev_samp(v) FILTER (fin), 0)', 'sd', 5)},
{r('quantile_cont(v, 0.025) FILTER (fin)', 'p025', 5)}, {r('quantile_cont(v, 0.5) FILTER (fin)', 'p500', 5)}, {r('quantile_cont(v, 0.975) FILTER (fin)', 'p975', 5)}, {r('count(*) FILTER (NOT fin) / count(*)', 'infinite_fraction', 5)} FROM f GROUP BY metric""",
)
def bootstrap_percentiles(spark, sf_dir, reps=REPS):
    return D.rounded(resampling.percentile_summary(replicates(spark, sf_dir, reps).drop("boundary_nodes", "rep"), [], list(_METRICS)), 5)


@query("continuous_threshold_bootstrap", f"""{BOOT} SELECT {r('median(n90)', 'continuous_median', 4)}, {r('median(ceil(n90))', 'integer_median', 4)}, {r('quantile_cont(n90, 0.025)', 'continuous_p025', 4)}, {r('quantile_cont(ceil(n90), 0.025)', 'integer_p025', 4)} FROM n90 WHERE isfinite(n90)""")
def continuous_threshold_bootstrap(spark, sf_dir):
    t = replicates(spark, sf_dir).filter(F.col("n90") < float("inf")).withColumn("whole", F.ceil("n90").cast("double"))
    return D.rounded(t.agg(F.median("n90").alias("continuous_median"), F.median("whole").alias("integer_median"), F.percentile("n90", F.lit(0.025)).alias("continuous_p025"), F.percentile("whole", F.lit(0.025)).alias("integer_p025")), 4)


@query("bootstrap_diagnostics", f"{BOOT} SELECT count(*) AS replicates, count(*) FILTER (b <= 0) AS zero_b, count(*) FILTER (boundary_nodes > 0) AS any_boundary, count(*) FILTER (NOT isfinite(n90)) AS undefined_n90, {r('max(n90) FILTER (isfinite(n90))', 'largest_n90', 3)} FROM n90")
def bootstrap_diagnostics(spark, sf_dir, reps=REPS):
    t = replicates(spark, sf_dir, reps)
    fin = F.col("n90") < float("inf")
    return D.rounded(t.agg(F.count("*").alias("replicates"), F.count_if(F.col("B") <= 0).alias("zero_b"), F.count_if(F.col("boundary_nodes") > 0).alias("any_boundary"), F.count_if(~fin).alias("undefined_n90"), F.max(F.when(fin, F.col("n90"))).alias("largest_n90")), 3)


@query("draw_uniqueness", f"WITH {DRAWS}, u AS (SELECT rep, count(DISTINCT athlete) AS d, max(cnt) AS mx FROM draws GROUP BY rep) SELECT count(*) AS replicates, min(d) AS least, max(d) AS greatest, max(mx) AS most_copies, {r('quantile_cont(d, 0.025)', 'p025')}, {r('quantile_cont(d, 0.5)', 'p500')}, {r('quantile_cont(d, 0.975)', 'p975')} FROM u")
def draw_uniqueness(spark, sf_dir):
    return D.rounded(resampling.uniqueness(drawn(spark, sf_dir)))


@query("block_quantiles", f"{BOOT}, bl AS (SELECT r10, ntile(5) OVER (ORDER BY rep) AS block FROM n90), q AS (SELECT block, quantile_cont(r10, 0.975) AS q FROM bl GROUP BY block) SELECT {r('min(q)', 'q_min', 7)}, {r('max(q)', 'q_max', 7)} FROM q")
def block_quantiles(spark, sf_dir):
    t = replicates(spark, sf_dir).withColumn("one", F.lit(1))
    return D.rounded(resampling.block_quantiles(t, ["one"], "r10", "rep").select("q_min", "q_max"), 7)


@query(
    "kde_quantile_se",
    f"""{BOOT}, s AS (SELECT quantile_cont(r10, 0.975) AS q, stddev_samp(r10) * count(*) ^ (-0.2) AS h, count(*) AS n FROM n90),
d AS (SELECT avg(exp(-0.5 * ((q - r10) / h) ^ 2)) / (max(h) * sqrt(2 * pi())) AS f, max(n) AS n, max(q) AS q FROM n90, s)
SELECT {r('q', 'q', 7)}, {r('sqrt(0.975 * 0.025 / n) / f', 'se', 6)} FROM d""",
)
def kde_quantile_se(spark, sf_dir):
    t = replicates(spark, sf_dir).withColumn("one", F.lit(1))
    return D.rounded(quantile_error(t, ["one"], "r10", 0.975).select("q", "se"), 6, q=7)


@query("basic_interval", f"{BOOT.replace('WITH', 'WITH', 1)}, {D.comp_sql('cells')}, pt AS (SELECT sum(sigma2_w * ({D.WEIGHT})) AS w FROM comp) SELECT {r('2 * pt.w - quantile_cont(n90.w, 0.975)', 'low', 8)}, {r('2 * pt.w - quantile_cont(n90.w, 0.025)', 'high', 8)} FROM n90, pt GROUP BY pt.w")
def basic_interval(spark, sf_dir):
    point = C.integrate(C.one_way_from_cells(cells(spark, sf_dir), ["node"]), [], D.NODES).select(F.col("W").alias("w"))
    q = replicates(spark, sf_dir).agg(F.percentile("W", F.lit(0.025)).alias("lo"), F.percentile("W", F.lit(0.975)).alias("hi"))
    low, high = resampling.basic_interval(F.col("w"), F.col("lo"), F.col("hi"))
    return D.rounded(point.crossJoin(q).select(low.alias("low"), high.alias("high")), 8)


def _cdf(x: str) -> str:
    """Normal distribution function by its series in odd powers; SQL has no error function."""
    return f"(0.5 + exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda k: {x} ^ (2 * k + 1) * sqrt(pi()) / (2 ^ (k + 1) * gamma(k + 1.5)))))"


def _bca() -> str:
    newton = ",\n".join(f"z{i} AS (SELECT theta, n, p, z - ({_cdf('z')} - p) / (exp(-z * z / 2) / sqrt(2 * pi())) AS z FROM z{i - 1})" for i in range(1, 9))
    tail = lambda sign: f"z + (z {sign} 1.959963984540054) / (1 - a * (z {sign} 1.959963984540054))"
    at = lambda p: f"l[floor({p} * (len(l) - 1))::INT + 1] + ({p} * (len(l) - 1) - floor({p} * (len(l) - 1))) * (l[least(len(l), floor({p} * (len(l) - 1))::INT + 2)] - l[floor({p} * (len(l) - 1))::INT + 1])"
    return f"""{BOOT}, {D.comp_sql('cells')}, pt AS (SELECT sum(sigma2_w * ({D.WEIGHT})) AS w FROM comp),
ex AS (SELECT DISTINCT athlete AS excluded FROM cells), lc AS (SELECT ex.excluded, cells.* FROM cells, ex WHERE athlete <> excluded), {D.comp_sql('lc', 'excluded, node', 'lo')},
jk AS (SELECT excluded, sum(sigma2_w * ({D.WEIGHT})) AS w FROM lo GROUP BY excluded),
ac AS (SELECT sum((c - w) ^ 3) / (6 * sum((c - w) ^ 2) ^ 1.5) AS a FROM jk, (SELECT avg(w) AS c FROM jk)),
sh AS (SELECT pt.w AS theta, count(*) AS n, sum(CASE WHEN round(n90.w, 12) < round(pt.w, 12) THEN 1.0 WHEN round(n90.w, 12) = round(pt.w, 12) THEN 0.5 ELSE 0 END)::DOUBLE AS less FROM n90, pt GROUP BY pt.w),
z0 AS (SELECT theta, n, greatest(0.5 / n, least(1 - 0.5 / n, less / n)) AS p, 0.0::DOUBLE AS z FROM sh),
{newton},
lim AS (SELECT theta, z AS bias, a AS acceleration, {tail('-')} AS x_low, {tail('+')} AS x_high FROM z8, ac),
pr AS (SELECT *, {_cdf('x_low')} AS p_low, {_cdf('x_high')} AS p_high FROM lim), v AS (SELECT list_sort(list(w)) AS l FROM n90)
SELECT 1 AS one, {r('theta', 'theta', 8)}, {r('bias', 'bias')}, {r('acceleration', 'acceleration')}, {r('p_low', 'p_low')}, {r('p_high', 'p_high')}, {r(at('p_low'), 'low', 7)}, {r(at('p_high'), 'high', 7)} FROM pr, v"""


@query("bca_interval", _bca())
def bca_interval(spark, sf_dir):
    """Values are rounded to twelve digits, so that a replicate of all groups once ties with the point."""
    one, w = F.lit(1).alias("one"), F.round("W", 12).alias("w")
    jack = C.integrate(influence.leave_one_out(cells(spark, sf_dir), ["node"]), ["excluded"], D.NODES).select(one, w)
    point = C.integrate(C.one_way_from_cells(cells(spark, sf_dir), ["node"]), [], D.NODES).select(one, w)
    return D.rounded(resampling.bca(replicates(spark, sf_dir).select(one, w), jack, point, ["one"], "w"), 6, theta=8, low=7, high=7)


_ACTION = """WITH c AS (SELECT label AS athlete, (vec_id % 3)::INT AS action, vec_id, row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) AS trial, embedding FROM embeddings),
bal AS (SELECT * FROM c WHERE trial <= (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY athlete, action))),
nodes AS (SELECT athlete, action, trial, unnest(range(0, 64))::INT AS node, unnest(embedding)::DOUBLE AS y FROM bal),
cells AS (SELECT action, athlete, node, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss FROM nodes GROUP BY ALL)"""


@query(
    "paired_contrasts",
    f"""{_ACTION}, {DRAWS},
bs AS (SELECT rep, action, node, sum(cnt)::BIGINT AS p, min(n) AS m, min(n) * greatest(sum(cnt * mean * mean) - sum(cnt * mean) ^ 2 / sum(cnt), 0) AS ssb, sum(cnt * ss) AS ssw FROM cells JOIN draws USING (athlete) GROUP BY ALL),
bm AS (SELECT *, ssb / (p - 1) AS msb, ssw / (p * (m - 1)) AS msw FROM bs),
bt AS (SELECT rep, action, sum(CASE WHEN msb >= msw THEN msw ELSE (ssb + ssw) / (p * m - 1) END * ({D.WEIGHT})) AS w FROM bm GROUP BY ALL),
d AS (SELECT a.action AS left_item, b.action AS right_item, b.w - a.w AS d FROM bt a JOIN bt b ON a.rep = b.rep AND a.action < b.action)
SELECT left_item, right_item, {r('quantile_cont(d, 0.025)', 'p025', 7)}, {r('quantile_cont(d, 0.5)', 'p500', 7)}, {r('quantile_cont(d, 0.975)', 'p975', 7)}, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM d GROUP BY ALL""",
)
def paired_contrasts(spark, sf_dir, reps=REPS):
    c = C.cell_statistics(D.action_nodes(spark, sf_dir), ["action", "node"])
    t = C.integrate(resampling.bootstrap_components(c, drawn(spark, sf_dir, reps), ["action", "node"]), ["rep", "action"], D.NODES)
    return D.rounded(resampling.contrasts(t.select("rep", "action", "W"), [], "action", "W"), 7)


_BANDS = f"""{_ACTION}, {DRAWS},
j AS (SELECT rep, cnt, cells.* FROM cells JOIN draws USING (athlete)),
pa AS (SELECT rep, node, athlete, max(cnt) AS cnt, count(*) AS a, min(n) AS r, avg(mean) AS mean, var_pop(mean) * count(*) AS apart, sum(ss) AS ss FROM j GROUP BY ALL),
pc AS (SELECT rep, node, action, sum(cnt * mean) / sum(cnt) AS mean FROM j GROUP BY ALL),
one AS (SELECT rep, node, sum(cnt) AS p, min(a) AS a, min(r) AS r, sum(cnt * mean * mean) - sum(cnt * mean) ^ 2 / sum(cnt) AS sp, sum(cnt * apart) AS rest, sum(cnt * ss) AS sse FROM pa GROUP BY ALL),
two AS (SELECT rep, node, var_pop(mean) * count(*) AS sa FROM pc GROUP BY ALL),
ms AS (SELECT *, a * r * greatest(sp, 0) / (p - 1) AS msp, p * r * sa / (a - 1) AS msa, r * (rest - p * sa) / ((p - 1) * (a - 1)) AS msi, sse / (p * a * (r - 1)) AS mse FROM one JOIN two USING (rep, node)),
v AS (SELECT node, greatest((msa - msi) / (p * r), 0) AS action, greatest((msp - msi) / (a * r), 0) AS athlete, greatest((msi - mse) / r, 0) AS action_athlete, mse AS residual FROM ms),
o AS (UNPIVOT (SELECT node, {', '.join(f'CASE WHEN action + athlete + action_athlete + residual > 0 THEN {k} / (action + athlete + action_athlete + residual) ELSE 0 END AS omega_{k}' for k in C.PARTS)} FROM v) ON omega_action, omega_athlete, omega_action_athlete, omega_residual INTO NAME component VALUE value)
SELECT component, node, {r('quantile_cont(value, 0.025)', 'p025', 7)}, {r('quantile_cont(value, 0.5)', 'p500', 7)}, {r('quantile_cont(value, 0.975)', 'p975', 7)} FROM o GROUP BY ALL"""


@query("bootstrap_bands", _BANDS)
def bootstrap_bands(spark, sf_dir):
    """Pointwise 2.5 to 97.5 % bands of two-way component shares over replicates."""
    n = D.action_nodes(spark, sf_dir)
    c = n.groupBy("node", "athlete", "action").agg(F.count("y").alias("r"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("y")).alias("ss"))
    boot = C.two_way_pointwise(resampling.bootstrap_two_way(c, drawn(spark, sf_dir), ["node"]))
    long = boot.select("node", "rep", *[f"omega_{k}" for k in C.PARTS]).unpivot(["node", "rep"], [f"omega_{k}" for k in C.PARTS], "component", "value")
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return D.rounded(long.groupBy("component", "node").agg(q.alias("q")).select("component", "node", *[F.get("q", F.lit(i)).alias(x) for i, x in enumerate(("p025", "p500", "p975"))]), 7)


@query(
    "balanced_subsample",
    f"""WITH {D.CURVES}, lim AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM c GROUP BY athlete)),
h AS (SELECT rep, athlete, trial, embedding, {_hash('5', 'rep', 'athlete', 'trial')} AS h FROM c, (SELECT unnest(range(1, {SUBSAMPLES + 1}))::INT AS rep)),
s AS (SELECT *, row_number() OVER (PARTITION BY rep, athlete ORDER BY h, trial) AS place FROM h),
nodes AS (SELECT rep, athlete, unnest(range(0, 64))::INT AS node, unnest(embedding)::DOUBLE AS y FROM s, lim WHERE place <= k),
cells AS (SELECT rep, athlete, node, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss FROM nodes GROUP BY ALL), {D.comp_sql('cells', 'rep, node')}
SELECT rep, {r(f'sum(sigma2_b * ({D.WEIGHT}))', 'B', 8)}, {r(f'sum(sigma2_w * ({D.WEIGHT}))', 'W', 8)}, count(*) FILTER (NOT interior) AS boundary_nodes FROM comp GROUP BY rep""",
)
def balanced_subsample(spark, sf_dir, reps=SUBSAMPLES):
    """Subsamples without replacement, from cells made by NumPy over chunks of each athlete's curves."""
    c = D.curves(spark, sf_dir)
    least = c.groupBy("athlete").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    s = resampling.subsample_cells(c.crossJoin(F.broadcast(least)), reps, 5, F.col("least"))
    t = C.integrate(C.one_way_from_cells(s, ["rep", "node"]), ["rep"], D.NODES)
    return D.rounded(t.select("rep", "B", "W", "boundary_nodes"), 8)


@query(
    "action_subsample",
    f"""WITH c AS (SELECT label AS athlete, (vec_id % 3)::INT AS action, row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) AS trial, embedding FROM embeddings),
lim AS (SELECT action, min(n) AS k FROM (SELECT action, count(*) AS n FROM c GROUP BY athlete, action) GROUP BY action),
h AS (SELECT rep, athlete, action, trial, {_hash('5', 'rep', 'athlete', 'action', 'trial')} AS h FROM c, (SELECT unnest(range(1, {SUBSAMPLES + 1}))::INT AS rep)),
p AS (SELECT *, row_number() OVER (PARTITION BY rep, athlete, action ORDER BY h, trial) AS place FROM h),
s AS (SELECT rep, athlete, action, list(trial) AS ts FROM p JOIN lim USING (action) WHERE place <= k GROUP BY ALL),
nodes AS (SELECT rep, athlete, action, unnest(range(0, 64))::INT AS node, unnest(embedding)::DOUBLE AS y FROM (SELECT rep, athlete, action, unnest(ts) AS trial FROM s) JOIN c USING (athlete, action, trial)),
cells AS (SELECT rep, athlete, action, node, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss FROM nodes GROUP BY ALL), {D.comp_sql('cells', 'rep, action, node')}
SELECT rep, action, max(m)::BIGINT AS selected, {r(f'sum(sigma2_b * ({D.WEIGHT}))', 'B', 8)}, {r(f'sum(sigma2_w * ({D.WEIGHT}))', 'W', 8)}, count(*) FILTER (NOT interior) AS boundary_nodes FROM comp GROUP BY rep, action""",
)
def action_subsample(spark, sf_dir, reps=SUBSAMPLES):
    """Subsamples of each cell of athlete and action without replacement, to the smallest cell of the action."""
    e = D.table(spark, sf_dir, "embeddings").select(F.col("label").alias("athlete"), (F.col("vec_id") % 3).cast("int").alias("action"), "vec_id", F.col("embedding").cast("array<double>").alias("y"))
    c = D.trial_rank(e, ["athlete", "action"], ["vec_id"])
    least = c.groupBy("athlete", "action").agg(F.count("*").alias("n")).groupBy("action").agg(F.min("n").alias("least"))
    s = resampling.subsample_cells(c.join(least, "action"), reps, 5, F.col("least"), also=("action",))
    comp = C.one_way_from_cells(s, ["rep", "action", "node"])
    w = node_weight(F.col("node"), D.NODES)
    t = comp.groupBy("rep", "action").agg(F.max("m").alias("selected"), F.sum(F.col("sigma2_b") * w).alias("B"), F.sum(F.col("sigma2_w") * w).alias("W"), F.count_if(~F.col("interior")).alias("boundary_nodes"))
    return D.rounded(t, 8)


def window_subsample(spark, sf_dir, reps):
    """The same subsamples by windows over hashes; tests hold one form against the other."""
    c = D.curves(spark, sf_dir)
    least = c.groupBy("athlete").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    s = resampling.subsample(c.crossJoin(F.broadcast(least)), reps, 5, ["athlete"], "trial", F.col("least"))
    t = C.integrate(C.one_way(s.select("rep", "athlete", "trial", F.posexplode("y").alias("node", "y")), ["rep", "node"]), ["rep"], D.NODES)
    return D.rounded(t.select("rep", "B", "W", "boundary_nodes"), 8)


@query("subsample_audit", "WITH c AS (SELECT label AS athlete, count(*) AS n FROM embeddings GROUP BY label), lim AS (SELECT min(n) AS k FROM c) SELECT athlete, n AS available, k AS selected, n - k AS left_out FROM c, lim")
def subsample_audit(spark, sf_dir):
    n = D.curves(spark, sf_dir).groupBy("athlete").agg(F.count("*").alias("available"))
    least = n.agg(F.min("available").alias("selected"))
    return n.crossJoin(F.broadcast(least)).select("athlete", "available", "selected", (F.col("available") - F.col("selected")).alias("left_out"))


_RESID = f"WITH {D.ALL_NODES}, res AS (SELECT athlete, trial, node, y - avg(y) OVER (PARTITION BY athlete, node) AS r FROM nodes)"
_W = D.WEIGHT.replace("node", "a.node")


@query(
    "lag_correlation",
    f"""{_RESID}, l AS (SELECT unnest(range(1, 11))::INT AS lag), s AS (SELECT lag, sum(({_W}) * a.r * b.r) AS c, sum(({_W}) * a.r * a.r) AS x, sum(({_W}) * b.r * b.r) AS y FROM res a, l, res b WHERE b.athlete = a.athlete AND b.node = a.node AND b.trial = a.trial + lag GROUP BY lag)
SELECT lag, {r('c / sqrt(x * y)', 'rho', 8)} FROM s""",
)
def lag_correlation(spark, sf_dir):
    resid = dependence.residuals(D.to_nodes(D.curves(spark, sf_dir)), [])
    return D.rounded(dependence.lag_correlation(resid, [], D.NODES, 10), 8)


def mixed_sql(source: str, *parts: str) -> str:
    """A subquery: source with ``resampling.mixed`` of the parts as h."""
    m, f, rounds = resampling.MODULUS, resampling.FACTOR, resampling.ROUNDS
    steps = [s for part in parts for s in (f"(h + (({part})::BIGINT % {m} + {m}) % {m} + 1) % {m}", *[f"(xor(h, h >> 15) * {f} + 1) % {m}"] * rounds)]
    out = f"(SELECT *, 0::BIGINT AS h FROM {source})"
    for step in steps:
        out = f"(SELECT * REPLACE ({step} AS h) FROM {out})"
    return out


def _permutations(n: int) -> str:
    return f"""{_RESID}, g AS (SELECT a.athlete, a.trial AS i, b.trial AS j, sum(({_W}) * a.r * b.r) AS g FROM res a JOIN res b ON a.athlete = b.athlete AND a.node = b.node GROUP BY ALL),
t AS (SELECT DISTINCT athlete, trial FROM res),
tr AS (SELECT rep, athlete, trial FROM t, (SELECT unnest(range(1, {n + 1}))::INT AS rep)),
o AS (SELECT 0 AS rep, athlete, trial, trial AS place FROM t UNION ALL SELECT rep, athlete, trial, row_number() OVER (PARTITION BY rep, athlete ORDER BY h, trial) FROM {mixed_sql('tr', '7', 'rep', 'athlete', 'trial')}),
p AS (SELECT a.rep, sum(x.g) / sqrt(sum(gi.g) * sum(gj.g)) AS rho FROM o a JOIN o b ON a.rep = b.rep AND a.athlete = b.athlete AND b.place = a.place + 1 JOIN g x ON x.athlete = a.athlete AND x.i = a.trial AND x.j = b.trial
 JOIN g gi ON gi.athlete = a.athlete AND gi.i = a.trial AND gi.j = a.trial JOIN g gj ON gj.athlete = a.athlete AND gj.i = b.trial AND gj.j = b.trial GROUP BY a.rep),
ob AS (SELECT rho FROM p WHERE rep = 0)
SELECT {r('ob.rho', 'rho', 8)}, count(*) AS permutations, {r('quantile_cont(p.rho, 0.025)', 'null_p025', 8)}, {r('quantile_cont(p.rho, 0.975)', 'null_p975', 8)}, {r('(1 + count(*) FILTER (abs(p.rho) >= abs(ob.rho))) / (count(*) + 1)', 'p_value', 8)} FROM p, ob WHERE rep > 0 GROUP BY ob.rho"""


#: Permutations of the smaller test; permutation_lag1_blas runs the reference's number.
_FEW = 500


@query("permutation_lag1", _permutations(_FEW))
def permutation_lag1(spark, sf_dir):
    """The test at a tenth of the reference's permutations, from each order's neighbours: products of all pairs are never made for large groups."""
    resid = dependence.residuals(D.to_nodes(D.curves(spark, sf_dir)), [])
    return D.rounded(dependence.permutation_test_blas(resid, [], D.NODES, _FEW, 7), 8)


@query("permutation_lag1_blas", _permutations(PERMUTATIONS))
def permutation_lag1_blas(spark, sf_dir):
    """The test at the reference's number of permutations, by one NumPy pass over each Gram matrix."""
    resid = dependence.residuals(D.to_nodes(D.curves(spark, sf_dir)), [])
    return D.rounded(dependence.permutation_test_blas(resid, [], D.NODES, PERMUTATIONS, 7), 8)


@query("gram_matrix", f"{_RESID} SELECT a.athlete, a.trial AS i, b.trial AS j, {r(f'sum(({_W}) * a.r * b.r)', 'g', 8)} FROM res a JOIN res b ON a.athlete = b.athlete AND a.node = b.node GROUP BY ALL")
def gram_matrix(spark, sf_dir):
    """Inner products of all pairs of an athlete's residual curves."""
    resid = dependence.residuals(D.to_nodes(D.curves(spark, sf_dir)), [])
    return D.rounded(dependence.gram(resid, [], D.NODES), 8)


_AR1 = f"""{_ACTION}, {D.comp_sql('cells', 'action, node')}, m AS (SELECT action, sum(sigma2_b * ({D.WEIGHT})) AS b, sum(sigma2_w * ({D.WEIGHT})) AS w FROM comp GROUP BY action),
res AS (SELECT action, athlete, trial, node, y - avg(y) OVER (PARTITION BY action, athlete, node) AS r FROM nodes),
lg AS (SELECT a.action, sum(({_W}) * a.r * b.r) AS c, sum(({_W}) * a.r * a.r) AS x, sum(({_W}) * b.r * b.r) AS y FROM res a JOIN res b ON a.action = b.action AND a.athlete = b.athlete AND a.node = b.node AND b.trial = a.trial + 1 GROUP BY a.action),
sc AS (SELECT action, 'fixed' AS scenario, unnest([0.0, 0.1, 0.2, 0.3])::DOUBLE AS phi FROM m UNION ALL SELECT action, 'archive_order_lag1', CASE WHEN x > 0 AND y > 0 THEN c / sqrt(x * y) END FROM lg),
k AS (SELECT unnest(range(1, 5001))::DOUBLE AS n),
e AS (SELECT action, scenario, phi, b, w, n, CASE WHEN n <= 1 THEN 1 ELSE 1 + 2 * (phi / (1 - phi) - phi * (1 - phi ^ n) / (n * (1 - phi) * (1 - phi))) END AS d FROM m JOIN sc USING (action), k),
g AS (SELECT *, CASE WHEN b + w * d / n > 0 THEN b / (b + w * d / n) ELSE 0 END AS rel FROM e),
f AS (SELECT action, scenario, phi, b, w, coalesce(min(n) FILTER (rel >= 0.9), 'Infinity'::DOUBLE) AS required_n, max(rel) FILTER (n = 50) AS r50 FROM g GROUP BY ALL)
SELECT action, scenario, {r('phi', 'phi', 8)}, {r('b', 'B', 8)}, {r('w', 'W', 8)}, {r('CASE WHEN b > 0 THEN w / b END', 'W_over_B', 4)}, {r("CASE WHEN b > 0 THEN 0.9 * w / ((1 - 0.9) * b) ELSE 'Infinity'::DOUBLE END", 'independence_continuous', 3)}, required_n,
 {r('CASE WHEN isfinite(required_n) THEN g.d END', 'design_effect', 7)}, {r('r50', 'reliability_at_50', 8)} FROM f LEFT JOIN (SELECT action, scenario, phi, n, d FROM g) g USING (action, scenario, phi) WHERE n = required_n OR (required_n = 'Infinity'::DOUBLE AND n = 1)"""


@query("ar1_thresholds", _AR1)
def ar1_thresholds(spark, sf_dir):
    """Thresholds of each action's fitted model at fixed correlations and at its residuals' own lag-1 correlation."""
    nodes = D.action_nodes(spark, sf_dir)
    models = C.integrate(C.one_way(nodes, ["action", "node"]), ["action"], D.NODES)
    lag1 = dependence.lag_correlation(dependence.residuals(nodes, ["action"]), ["action"], D.NODES, 1)
    return D.rounded(dependence.ar1_scenarios(models, lag1, ["action"]), 8, W_over_B=4, independence_continuous=3, design_effect=7)


@query(
    "ar1_scenarios",
    f"""{D.INTEGRATED}, sc AS (SELECT unnest(['independence', 'phi_0_1', 'phi_0_2', 'phi_0_3']) AS scenario, unnest([0.0, 0.1, 0.2, 0.3])::DOUBLE AS phi), ns AS (SELECT unnest([1, 10, 50, 200])::INT AS n),
e AS (SELECT *, CASE WHEN n <= 1 THEN 1 ELSE 1 + 2 * (phi / (1 - phi) - phi * (1 - phi ^ n) / (n * (1 - phi) * (1 - phi))) END AS d FROM tot, sc, ns)
SELECT scenario, n, {r('d', 'design_effect', 8)}, {r('b / (b + w * d / n)', 'reliability', 8)} FROM e""",
)
def ar1_scenarios(spark, sf_dir):
    t = C.integrate(C.one_way_from_cells(cells(spark, sf_dir), ["node"]), [], D.NODES)
    names = {"independence": 0.0, "phi_0_1": 0.1, "phi_0_2": 0.2, "phi_0_3": 0.3}
    sc = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(v).alias("phi")) for k, v in names.items()])).alias("s")).select("s.*")
    every = t.crossJoin(F.broadcast(sc)).crossJoin(F.broadcast(C.grid(spark, [1, 10, 50, 200])))
    n, phi = F.col("n").cast("double"), F.col("phi")
    return D.rounded(every.select("scenario", "n", R.ar1_design_effect(n, phi).alias("design_effect"), R.ar1_reliability(F.col("B"), F.col("W"), n, phi).alias("reliability")), 8)


_LOO = f"""WITH {D.NODES_SQL}, {D.CELLS}, ex AS (SELECT DISTINCT athlete AS excluded FROM cells), lc AS (SELECT ex.excluded, cells.* FROM cells, ex WHERE athlete <> excluded),
{D.comp_sql('lc', 'excluded, node')}"""


@query("loo_components", f"{_LOO} SELECT excluded, {r(f'sum(sigma2_b * ({D.WEIGHT}))', 'B', 8)}, {r(f'sum(sigma2_w * ({D.WEIGHT}))', 'W', 8)}, count(*) FILTER (NOT interior) AS boundary_nodes FROM comp GROUP BY excluded")
def loo_components(spark, sf_dir):
    t = C.integrate(influence.leave_one_out(cells(spark, sf_dir), ["node"]), ["excluded"], D.NODES)
    return D.rounded(t.select("excluded", "B", "W", "boundary_nodes"), 8)


@query(
    "athlete_contributions",
    f"""WITH {D.NODES_SQL}, {D.CELLS}, g AS (SELECT *, avg(mean) OVER (PARTITION BY node) AS gm FROM cells),
t AS (SELECT athlete, sum(({D.WEIGHT}) * ss) AS a, sum(({D.WEIGHT}) * (mean - gm) ^ 2) AS b FROM g GROUP BY athlete)
SELECT athlete, {r('a / sum(a) OVER ()', 'within_share', 8)}, {r('b / sum(b) OVER ()', 'deviation_share', 8)} FROM t""",
)
def athlete_contributions(spark, sf_dir):
    c = influence.contributions(cells(spark, sf_dir).withColumn("family", F.lit(1)), ["family"], D.NODES)
    return D.rounded(c.select("athlete", "within_share", "deviation_share"), 8)


@query(
    "cohort_scenarios",
    f"""WITH {D.NODES_SQL}, {D.CELLS}, sc AS (SELECT 'first' AS scenario, unnest(range(0, 6))::INT AS code UNION ALL SELECT 'last', unnest(range(4, 10))::INT UNION ALL SELECT 'all', unnest(range(0, 10))::INT),
s AS (SELECT scenario, cells.* FROM cells JOIN sc ON athlete = code), {D.comp_sql('s', 'scenario, node')}
SELECT scenario, max(p) AS codes, {r(f'sum(sigma2_b * ({D.WEIGHT}))', 'B', 8)}, {r(f'sum(sigma2_w * ({D.WEIGHT}))', 'W', 8)} FROM comp GROUP BY scenario""",
)
def cohort_scenarios(spark, sf_dir):
    windows = {"first": (0, 5), "last": (4, 9), "all": (0, 9)}
    rows = [F.struct(F.lit(k).alias("scenario"), F.sequence(F.lit(a), F.lit(b)).alias("codes")) for k, (a, b) in windows.items()]
    sc = spark.range(1).select(F.explode(F.array(*rows)).alias("s")).select("s.scenario", F.explode("s.codes").alias("athlete"))
    comp = C.one_way_from_cells(cells(spark, sf_dir).join(F.broadcast(sc), "athlete"), ["scenario", "node"])
    p = comp.groupBy("scenario").agg(F.max("p").alias("codes"))
    return D.rounded(C.integrate(comp, ["scenario"], D.NODES).join(p, "scenario").select("scenario", "codes", "B", "W"), 8)


def _estimands() -> str:
    """Least number of trials by each estimand; of the pointwise one by steps of whole trials."""
    pick = lambda t: f"(SELECT min(n) FROM pn WHERE mp >= {t})"
    trace = lambda t: f"CASE WHEN b > 0 THEN greatest(1.0, ceil({t} * w / ((1 - {t}) * b) * 0.9999999999999999)) ELSE 'Infinity'::DOUBLE END"
    columns = [(f"required_n_R_L2_{round(100 * t)}", trace(t)) for t in R.TARGETS] + [(f"required_n_mean_pointwise_R_{round(100 * t)}", f"coalesce({pick(t)}, 'Infinity'::DOUBLE)") for t in R.TARGETS]
    inner = ", ".join(f"{v} AS {k}" for k, v in columns)
    minus = ", ".join(f"required_n_mean_pointwise_R_{t} - required_n_R_L2_{t} AS pointwise_minus_trace_n{t}" for t in (80, 90))
    return f"""{D.INTEGRATED}, k AS (SELECT unnest(range(1, 20001))::DOUBLE AS n),
pn AS (SELECT n, sum((CASE WHEN sigma2_b > 0 THEN sigma2_b / (sigma2_b + sigma2_w / n) ELSE 0 END) * ({D.WEIGHT})) AS mp FROM comp, k GROUP BY n), x AS (SELECT {inner} FROM tot) SELECT *, {minus} FROM x"""


@query("estimand_comparison", _estimands())
def estimand_comparison(spark, sf_dir):
    """Thresholds of the mean pointwise reliability minus those of the trace, for both targets."""
    s = C.component_summary(C.one_way_from_cells(cells(spark, sf_dir), ["node"]), [], D.NODES)
    cols = [c for c in s.columns if c.startswith("required")]
    return s.select(*cols, *[(F.col(f"required_n_mean_pointwise_R_{t}") - F.col(f"required_n_R_L2_{t}")).alias(f"pointwise_minus_trace_n{t}") for t in (80, 90)])


@query("blas_bootstrap", f"{BOOT} SELECT rep, {r('b', 'B', 8)}, {r('w', 'W', 8)}, boundary_nodes FROM n90")
def blas_bootstrap(spark, sf_dir):
    """Integrated components of all replicates by matrix products on group statistics."""
    counts = lambda k: resampling.drawn_counts(SEED, REPS, k)
    return D.rounded(C.integrate(resampling.blas_bootstrap(cells(spark, sf_dir), counts, ["node"]), ["rep"], D.NODES).select("rep", "B", "W", "boundary_nodes"), 8)


def _metrics() -> str:
    """Metrics of every replicate; pointwise thresholds by halving the range of whole trials twenty times."""
    weight = f"list_transform(range(0, 64), lambda node: {D.WEIGHT})"
    point = lambda n: f"list_sum(list_transform(range(1, 65), lambda i: ws[i] * CASE WHEN sb[i] + sw[i] / {n} > 0 THEN sb[i] / (sb[i] + sw[i] / {n}) ELSE 0 END))"
    trace = lambda t: f"CASE WHEN b > 0 THEN greatest(1.0, ceil({t} * w / ((1 - {t}) * b) * 0.9999999999999999)) ELSE 'Infinity'::DOUBLE END"
    steps = [f"h0 AS (SELECT rep, target, ws, sb, sw, 1::BIGINT AS lo, 1000000::BIGINT AS hi, {point('1000000.0')} >= target AND list_sum(list_transform(range(1, 65), lambda i: CASE WHEN sb[i] > 0 THEN ws[i] ELSE 0 END)) + 1e-14 >= target AS reached FROM ar, (SELECT unnest([0.8, 0.9])::DOUBLE AS target))"]
    for i in range(1, 21):
        steps.append(f"m{i} AS (SELECT *, {point('((lo + hi) // 2)')} >= target AS enough FROM h{i - 1})")
        steps.append(f"h{i} AS (SELECT rep, target, ws, sb, sw, CASE WHEN lo >= hi OR enough THEN lo ELSE (lo + hi) // 2 + 1 END AS lo, CASE WHEN lo < hi AND enough THEN (lo + hi) // 2 ELSE hi END AS hi, reached FROM m{i})")
    columns = [r(f"CASE WHEN b + w / {n} > 0 THEN b / (b + w / {n}) ELSE 0 END", f"R_L2_m{n}", 7) + ", " + r(point(f"{n}.0"), f"mean_pointwise_reliability_m{n}", 7) for n in R.GRID]
    for t in R.TARGETS:
        columns.append(f"{trace(t)} AS required_n_R_L2_{round(100 * t)}, max(CASE WHEN reached THEN lo::DOUBLE ELSE 'Infinity'::DOUBLE END) FILTER (target = {t}) OVER (PARTITION BY rep) AS required_n_mean_pointwise_R_{round(100 * t)}")
    return f"""{BOOT}, ar AS (SELECT rep, {weight} AS ws, list(sigma2_b ORDER BY node) AS sb, list(sigma2_w ORDER BY node) AS sw FROM bc GROUP BY rep), {', '.join(steps)}
SELECT DISTINCT rep, {r('b', 'B', 8)}, {r('w', 'W', 8)}, boundary_nodes, {r('boundary_nodes / 64', 'boundary_fraction', 8)}, {', '.join(columns)} FROM h20 JOIN n90 USING (rep)"""


@query("replicate_metrics", _metrics())
def replicate_metrics(spark, sf_dir):
    """Components, both reliabilities over the grid and both thresholds at the targets of each of 5,000 replicates."""
    counts = lambda k: resampling.drawn_counts(SEED, REPS, k)
    boot = resampling.blas_bootstrap(cells(spark, sf_dir), counts, ["node"])
    return D.rounded(replicates_of.metric_table(boot, ["rep"], D.NODES), 7, B=8, W=8, boundary_fraction=8)


#: Streams of the families of the two-way bootstrap lie this far apart, so that their draws aren't paired.
STREAM = 1009
_FAMILIES = ("racket", "body")
_HALF = D.WEIGHT.replace("63", "31")


def _shares() -> str:
    families = ", ".join(f"('{f}', {SEED + STREAM * i})" for i, f in enumerate(_FAMILIES))
    parts = ", ".join(f"sum({k} * ({_HALF})) AS {k}" for k in C.PARTS)
    whole = "(action + athlete + action_athlete + residual)"
    metrics = {f"omega_{k}": f"CASE WHEN {whole} > 0 THEN {k} / {whole} ELSE 0 END" for k in C.PARTS} | {
        "all_cells_n10": "CASE WHEN action + athlete + action_athlete + residual / 10 > 0 THEN (action + athlete + action_athlete) / (action + athlete + action_athlete + residual / 10) ELSE 0 END",
        "pooled_fixed_actions_n10": "CASE WHEN athlete + action_athlete + residual / 10 > 0 THEN (athlete + action_athlete) / (athlete + action_athlete + residual / 10) ELSE 0 END",
        "athlete_across_actions_n50": "CASE WHEN athlete > 0 THEN athlete / (athlete + action_athlete / 6 + residual / (6 * 50)) ELSE 0 END",
    }
    return f"""{_ACTION}, fam(family, seed) AS (VALUES {families}), fc AS (SELECT CASE WHEN node < 32 THEN 'racket' ELSE 'body' END AS family, node % 32 AS node, athlete, action, n, mean, ss FROM cells),
grp AS (SELECT athlete, row_number() OVER (ORDER BY athlete) - 1 AS pos FROM (SELECT DISTINCT athlete FROM cells)), k AS (SELECT count(*) AS k FROM grp),
picks AS (SELECT family, rep, {_hash('seed', 'rep', 'd')} % k AS pos FROM fam, (SELECT unnest(range(1, {REPS + 1}))::INT AS rep), k, (SELECT unnest(range(0, (SELECT k FROM k))) AS d)),
draws AS (SELECT family, rep, athlete, count(*) AS cnt FROM picks JOIN grp USING (pos) GROUP BY ALL),
j AS (SELECT fc.*, rep, cnt FROM fc JOIN draws USING (family, athlete)),
pa AS (SELECT family, rep, node, athlete, max(cnt) AS cnt, count(*) AS a, min(n) AS r, avg(mean) AS mean, var_pop(mean) * count(*) AS apart, sum(ss) AS ss FROM j GROUP BY ALL),
pc AS (SELECT family, rep, node, action, sum(cnt * mean) / sum(cnt) AS mean FROM j GROUP BY ALL),
one AS (SELECT family, rep, node, sum(cnt) AS p, min(a) AS a, min(r) AS r, sum(cnt * mean * mean) - sum(cnt * mean) ^ 2 / sum(cnt) AS sp, sum(cnt * apart) AS rest, sum(cnt * ss) AS sse FROM pa GROUP BY ALL),
two AS (SELECT family, rep, node, var_pop(mean) * count(*) AS sa FROM pc GROUP BY ALL),
ms AS (SELECT *, a * r * greatest(sp, 0) / (p - 1) AS msp, p * r * sa / (a - 1) AS msa, r * (rest - p * sa) / ((p - 1) * (a - 1)) AS msi, sse / (p * a * (r - 1)) AS mse FROM one JOIN two USING (family, rep, node)),
v AS (SELECT family, rep, node, greatest((msa - msi) / (p * r), 0) AS action, greatest((msp - msi) / (a * r), 0) AS athlete, greatest((msi - mse) / r, 0) AS action_athlete, mse AS residual FROM ms),
i AS (SELECT family, rep, {parts} FROM v GROUP BY ALL),
o AS (UNPIVOT (SELECT family, {', '.join(f'{v} AS {k}' for k, v in metrics.items())} FROM i) ON {', '.join(metrics)} INTO NAME metric VALUE value)
SELECT family, metric, count(*) AS replicates, {r('quantile_cont(value, 0.025)', 'p025', 7)}, {r('quantile_cont(value, 0.5)', 'p500', 7)}, {r('quantile_cont(value, 0.975)', 'p975', 7)} FROM o GROUP BY ALL"""


@query("twoway_bootstrap_shares", _shares())
def twoway_bootstrap_shares(spark, sf_dir):
    """Limits of the scalar shares and context reliabilities over 5,000 two-way replicates of either family (half of a vector), drawn apart."""
    n = D.action_nodes(spark, sf_dir)
    c = n.groupBy("node", "athlete", "action").agg(F.count("y").alias("r"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("y")).alias("ss"))
    half = D.NODES // 2
    c = c.withColumn("family", F.when(F.col("node") < half, _FAMILIES[0]).otherwise(_FAMILIES[1])).withColumn("node", F.col("node") % half)
    counts = lambda family, k: resampling.drawn_counts(SEED + STREAM * _FAMILIES.index(family), REPS, k)
    table = replicates_of.share_table(replicates_of.two_way_replicates(c, counts, ["family", "node"], "family"), ["family"], node_weight(F.col("node"), half))
    return D.rounded(replicates_of.limits(table, ["family"], [x for x in table.columns if x not in ("family", "rep")]), 7)


_LOO_ACTION = f"""{_ACTION}, ex AS (SELECT DISTINCT athlete AS excluded FROM cells), lc AS (SELECT ex.excluded, cells.* FROM cells, ex WHERE athlete <> excluded),
{D.comp_sql('lc', 'excluded, action, node')}, t AS (SELECT excluded, action, sum(sigma2_w * ({D.WEIGHT})) AS w FROM comp GROUP BY ALL),
pv AS (SELECT excluded AS athlete, {', '.join(f'max(w) FILTER (action = {a}) AS w{a}' for a in range(3))} FROM t GROUP BY excluded),
fl AS (SELECT label AS athlete, count(*) AS trials, count(*) FILTER (list_max(embedding) > 0.35) AS flagged FROM embeddings GROUP BY label)"""


@query("loo_flag_merge", f"{_LOO_ACTION} SELECT athlete, trials, flagged, {', '.join(r(f'w{a}', f'W_without_{a}', 8) for a in range(3))} FROM fl LEFT JOIN pv USING (athlete)")
def loo_flag_merge(spark, sf_dir):
    """Flagged trials of each athlete, merged with the integrated within component of each action without that athlete."""
    flags = D.curves(spark, sf_dir).groupBy("athlete").agg(F.count("*").alias("trials"), F.count_if(F.array_max("y") > F.lit(0.35)).alias("flagged"))
    c = C.cell_statistics(D.action_nodes(spark, sf_dir), ["action", "node"])
    t = C.integrate(influence.leave_one_out(c, ["action", "node"]), ["excluded", "action"], D.NODES)
    wide = t.groupBy(F.col("excluded").alias("athlete")).pivot("action", [0, 1, 2]).agg(F.max("W"))
    return D.rounded(flags.join(wide, "athlete", "left").select("athlete", "trials", "flagged", *[F.col(str(a)).alias(f"W_without_{a}") for a in range(3)]), 8)
