"""Queries of windows, joins, aggregates, sets and integrity constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvestat.catalog import CORE
from curvestat.operators import checks, influence, reshape, segments, windows
from curvestat.operators.curve_audit import is_zero
from curvestat.operators.quantiles import quantiles
from curvestat.plans import designs as D
from curvestat.plans.designs import r
from curvestat.schema import JOINTS

query = CORE.query


@query("trial_rank", "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT AS trial FROM events")
def trial_rank(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return windows.trial_rank(e, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "trial")


_ROBUST = """WITH a AS (SELECT *, median(value) OVER (PARTITION BY event_type) AS md FROM events),
b AS (SELECT *, median(abs(value - md)) OVER (PARTITION BY event_type) AS mad FROM a),
z AS (SELECT event_id, event_type, value, md, mad, CASE WHEN mad > 0 THEN (value - md) / (1.4826 * mad) END AS z FROM b)"""


@query("robust_z_audit", f"{_ROBUST} SELECT event_id, event_type, {r('md', 'median')}, {r('mad', 'mad')}, {r('z', 'robust_z')} FROM z")
def robust_z_audit(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return D.rounded(windows.robust_z(e, ["event_type"], "value").select("event_id", "event_type", "median", "mad", "robust_z"))


@query("topk_extreme", f"{_ROBUST}, k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM z) SELECT event_type, event_id, place::INT AS place, {r('value', 'value')} FROM k WHERE place <= 20")
def topk_extreme(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return D.rounded(windows.top_per_group(e, ["event_type"], [F.col("value").desc(), F.col("event_id")], 20).select("event_type", "event_id", "place", "value"))


@query("largest_one", f"SELECT event_id, user_id, {r('value', 'value')} FROM events ORDER BY events.value DESC, event_id LIMIT 1")
def largest_one(spark, sf_dir):
    return D.rounded(D.table(spark, sf_dir, "events").orderBy(F.col("value").desc(), "event_id").limit(1).select("event_id", "user_id", "value"))


@query("lag_pairs", f"WITH {D.SEQ}, l AS (SELECT user_id, week, step, value, lead(value, 3) OVER (PARTITION BY user_id, week ORDER BY step) AS later FROM seq) SELECT user_id, week, step::INT AS step, {r('value', 'value')}, {r('later', 'later')} FROM l WHERE later IS NOT NULL")
def lag_pairs(spark, sf_dir):
    s = D.sequences(spark, sf_dir)
    return D.rounded(windows.lag_pairs(s, ["user_id", "week"], "step", "value", 3).select("user_id", "week", "step", "value", "later"))


@query("within_group_centring", f"SELECT event_id, {r('value - avg(value) OVER (PARTITION BY user_id)', 'r', 9)} FROM events")
def within_group_centring(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return D.rounded(windows.centred(e, ["user_id"], "value").select("event_id", "r"), 9)


@query("share_of_total", f"WITH t AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL) SELECT user_id, event_type, {r('v / sum(v) OVER (PARTITION BY user_id)', 'share', 8)} FROM t")
def share_of_total(spark, sf_dir):
    t = D.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return D.rounded(windows.share_of_total(t, ["user_id"], "v").select("user_id", "event_type", "share"), 8)


@query(
    "contiguity_audit",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS idx, row_number() OVER w AS at_row, l_orderkey * 10 + l_linenumber - lag(l_orderkey * 10 + l_linenumber) OVER w AS rise FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, count(*) AS rows, bool_and(l_linenumber = at_row) AS labels_complete, bool_and(coalesce(rise = 1, true)) AS contiguous, min(idx) AS first_index, max(idx) AS last_index FROM x GROUP BY l_orderkey""",
)
def contiguity_audit(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"))
    return windows.contiguity(li, ["l_orderkey"], "l_linenumber", "idx")


@query(
    "segmented_ranks",
    f"""SELECT event_id, event_type, row_number() OVER w AS trial, {r('value - lag(value) OVER w', 'rise')}, {r('lead(value, 5) OVER w', 'later')} FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
)
def segmented_ranks(spark, sf_dir):
    """Running numbers, first differences and lag pairs of a few hot groups, each over many partitions."""
    e = D.table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    keys = ["event_type"]
    numbered = segments.ranked(e, keys, ["ts", "event_id"])
    both = segments.neighbour(segments.neighbour(numbered, keys, "value", 1, "before"), keys, "value", -5, "later")
    return D.rounded(both.select("event_id", "event_type", "trial", (F.col("value") - F.col("before")).alias("rise"), "later"))


@query(
    "segmented_contiguity",
    """WITH x AS (SELECT l_linenumber, l_orderkey, row_number() OVER w AS at_row, l_orderkey - lag(l_orderkey) OVER w AS rise FROM lineitem WINDOW w AS (PARTITION BY l_linenumber ORDER BY l_orderkey))
SELECT l_linenumber, count(*) AS rows, bool_and(l_orderkey = at_row) AS labels_complete, bool_and(coalesce(rise = 1, true)) AS contiguous, min(l_orderkey) AS first_index, max(l_orderkey) AS last_index FROM x GROUP BY l_linenumber""",
)
def segmented_contiguity(spark, sf_dir):
    """Whether orders are complete and in sequence in each line number's cell, the largest of which holds all orders."""
    return segments.contiguity(D.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey"), ["l_linenumber"], "l_orderkey", "l_orderkey")


@query("exact_duplicates", "WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), g AS (SELECT sha, count(*) AS group_size FROM h GROUP BY sha HAVING count(*) > 1), n AS (SELECT sha, group_size, row_number() OVER (ORDER BY sha)::INT AS duplicate_group FROM g) SELECT doc_id, sha, group_size, duplicate_group FROM h JOIN n USING (sha)")
def exact_duplicates(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return influence.duplicate_groups(d, "sha").select("doc_id", "sha", "group_size", "duplicate_group")


@query(
    "dedup_choice",
    """WITH h AS (SELECT doc_id, (doc_id % 40)::INT AS participant, sha256(text) AS sha FROM documents), g AS (SELECT sha, count(*) AS group_size FROM h GROUP BY sha HAVING count(*) > 1), n AS (SELECT sha, group_size, row_number() OVER (ORDER BY sha)::INT AS duplicate_group FROM g),
m AS (SELECT *, count(*) FILTER (participant > 30) OVER (PARTITION BY duplicate_group) AS above, row_number() OVER (PARTITION BY duplicate_group ORDER BY participant DESC, doc_id DESC) AS place FROM h JOIN n USING (sha))
SELECT duplicate_group, group_size, participant, doc_id, above = 1 AS quarantined FROM m WHERE place = 1""",
)
def dedup_choice(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).cast("int").alias("participant"), F.sha2("text", 256).alias("sha"))
    return influence.duplicate_removals(influence.duplicate_groups(d, "sha"), "participant", "doc_id", 30)


@query(
    "content_digest",
    """WITH e AS (SELECT vec_id, label, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, label, embedding FROM embeddings WHERE vec_id % 50 = 0)
SELECT vec_id, label FROM e QUALIFY count(*) OVER (PARTITION BY embedding[1:30], embedding[33:62]) > 1""",
)
def content_digest(spark, sf_dir):
    """Trials whose racket and body curves (either half of a vector) agree over the observable 30 of 32 frames; every fiftieth is copied."""
    from curvestat.functions.arrays import digest, observable

    e = D.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    every = e.unionByName(e.filter(F.col("vec_id") % 50 == 0).withColumn("vec_id", F.col("vec_id") + 1000000))
    racket, body = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    d = digest(*[observable(x, F.lit(30), 32) for x in (racket, body)])
    return influence.duplicate_groups(every.withColumn("d", d), "d").select("vec_id", "label")


@query("cell_counts", "SELECT label, count(*) AS rows FROM embeddings GROUP BY label HAVING count(*) <> 50")
def cell_counts(spark, sf_dir):
    return checks.cell_counts(D.table(spark, sf_dir, "embeddings"), ["label"], 50)


@query("row_count_check", "SELECT count(*) AS rows FROM events HAVING count(*) <> 12000")
def row_count_check(spark, sf_dir):
    return checks.row_count(D.table(spark, sf_dir, "events"), 12000)


@query("repeated_keys", "SELECT user_id, event_type, count(*) AS rows FROM events GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return checks.repeated_keys(D.table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query(
    "key_set_diff",
    """WITH k AS (SELECT DISTINCT user_id, floor((ts::DATE - DATE '1970-01-01') / 7)::INT AS week FROM events),
h AS (SELECT * FROM k WHERE (user_id + week) % 17 <> 0 UNION ALL SELECT DISTINCT -1 - user_id % 3, week FROM k WHERE user_id < 5),
f AS (SELECT a.user_id, b.week FROM (SELECT DISTINCT user_id FROM k) a, (SELECT DISTINCT week FROM k) b)
SELECT user_id, week, 'missing' AS problem FROM (FROM f EXCEPT FROM h) UNION ALL SELECT user_id, week, 'unexpected' FROM (FROM h EXCEPT FROM f)""",
)
def key_set_diff(spark, sf_dir):
    """Differences to the full product of users and weeks, with keys taken out and unknown users put in."""
    k = D.sequences(spark, sf_dir).select("user_id", "week").distinct()
    unknown = k.filter("user_id < 5").select((-1 - F.col("user_id") % 3).cast(k.schema["user_id"].dataType).alias("user_id"), "week").distinct()
    held = k.filter((F.col("user_id") + F.col("week")) % 17 != 0).unionByName(unknown)
    return checks.key_differences(held, checks.full_product(k, ["user_id", "week"]), ["user_id", "week"])


@query("not_finite", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda v: NOT isfinite(v))) > 0 OR vec_id % 97 = 0")
def not_finite(spark, sf_dir):
    e = D.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("y"))
    spoilt = e.withColumn("y", F.when(F.col("vec_id") % 97 == 0, F.array_append("y", F.lit(float("nan")))).otherwise(F.col("y")))
    return checks.not_finite(spoilt).select("vec_id")


@query("pairing_inner", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def pairing_inner(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query("pairing_missing", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pairing_missing(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", "source").join(D.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("semi_join_mask", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_mask(spark, sf_dir):
    mask = D.table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return D.table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(mask, "doc_id", "left_semi")


@query("left_lookup", f"SELECT c_custkey, n_name, r_name, coalesce(o, 0) AS orders, {r('t', 'total', 2)} FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS o, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def left_lookup(spark, sf_dir):
    n, g = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "region")
    o = D.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    places = n.join(g, n.n_regionkey == g.r_regionkey, "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    c = D.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(places, "c_nationkey", "left").join(o, "c_custkey", "left")
    return D.rounded(c.select("c_custkey", "n_name", "r_name", F.coalesce("orders", F.lit(0).cast("bigint")).alias("orders"), "total"), 2)


@query(
    "robustness_merge",
    f"""WITH a AS (SELECT l_returnflag AS f, avg(l_quantity) AS q FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS f, avg(l_quantity) AS q FROM lineitem WHERE l_discount < 0.05 GROUP BY 1),
c AS (SELECT l_returnflag AS f, median(l_quantity) AS q FROM lineitem GROUP BY 1), d AS (SELECT l_returnflag AS f, quantile_cont(l_quantity, 0.95) AS q FROM lineitem GROUP BY 1)
SELECT f AS l_returnflag, {r('a.q', 'q_main')}, {r('b.q', 'q_low')}, {r('c.q', 'q_median')}, {r('d.q', 'q_p95')} FROM a JOIN b USING (f) JOIN c USING (f) JOIN d USING (f)""",
)
def robustness_merge(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    q = F.col("l_quantity")
    return D.rounded(li.groupBy("l_returnflag").agg(F.avg(q).alias("q_main"), F.avg(F.when(F.col("l_discount") < 0.05, q)).alias("q_low"), F.median(q).alias("q_median"), F.percentile(q, F.lit(0.95)).alias("q_p95")))


@query("ordered_pairs", f"WITH t AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT a.user_id, a.event_type AS left_item, b.event_type AS right_item, {r('b.v - a.v', 'd')} FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_type < b.event_type")
def ordered_pairs(spark, sf_dir):
    t = D.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    left = t.select("user_id", F.col("event_type").alias("left_item"), F.col("v").alias("a"))
    right = t.select("user_id", F.col("event_type").alias("right_item"), F.col("v").alias("b"))
    return D.rounded(left.join(right, "user_id").filter("left_item < right_item").select("user_id", "left_item", "right_item", (F.col("b") - F.col("a")).alias("d")))


@query("threshold_counts", "SELECT event_type, t AS threshold, count(*) FILTER (value > t) AS above FROM events, (SELECT unnest([25.0, 50.0, 100.0, 200.0, 500.0])::DOUBLE AS t) GROUP BY ALL")
def threshold_counts(spark, sf_dir):
    from curvestat.operators.components import grid

    levels = grid(spark, [25.0, 50.0, 100.0, 200.0, 500.0], "threshold")
    e = D.table(spark, sf_dir, "events").select("event_type", "value").crossJoin(F.broadcast(levels))
    return e.groupBy("event_type", "threshold").agg(F.count_if(F.col("value") > F.col("threshold")).alias("above"))


@query("basic_aggregates", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {r('sum(l_quantity)', 'total', 2)}, {r('avg(l_extendedprice)', 'mean', 4)}, {r('min(l_discount)', 'least')}, {r('max(l_tax)', 'greatest')}, {r('median(l_quantity)', 'med')}, {r('stddev_samp(l_quantity)', 'sd')} FROM lineitem GROUP BY ALL")
def basic_aggregates(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem")
    return D.rounded(li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_discount").alias("least"), F.max("l_tax").alias("greatest"), F.median("l_quantity").alias("med"), F.stddev_samp("l_quantity").alias("sd")))


@query("count_any_all", "SELECT user_id, count(*) FILTER (value > 50) AS high, bool_or(value > 200) AS any_high, bool_and(value >= 0) AS all_positive FROM events GROUP BY user_id")
def count_any_all(spark, sf_dir):
    v = F.col("value")
    return D.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(v > 50).alias("high"), F.bool_or(v > 200).alias("any_high"), F.bool_and(v >= 0).alias("all_positive"))


_QS = (0.5, 0.9, 0.95, 0.99, 0.999, 1.0)


@query("linear_quantiles", "SELECT event_type, " + ", ".join(r(f"quantile_cont(value, {q})", f"p{str(q).replace('.', '_')}") for q in _QS) + " FROM events GROUP BY event_type")
def linear_quantiles(spark, sf_dir):
    q = quantiles(D.table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", list(_QS))
    return D.rounded(q.select("event_type", *[F.get("q", F.lit(i)).alias(f"p{str(x).replace('.', '_')}") for i, x in enumerate(_QS)]))


@query("flag_pivot", "SELECT u.user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT * FROM events WHERE value > 60) e ON e.user_id = u.user_id GROUP BY u.user_id")
def flag_pivot(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return reshape.count_matrix(e.filter(F.col("value") > 60), e, "user_id", "event_type", ["click", "view", "purchase"])


@query("value_histogram", "SELECT event_type, least(floor(value / 100 * 20), 19)::INT AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL")
def value_histogram(spark, sf_dir):
    return reshape.histogram(D.table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", 0.0, 100.0, 20)


@query("unpivot_metrics", f"SELECT l_orderkey, l_linenumber, metric, {r('v', 'value')} FROM (SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS metric, unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem)")
def unpivot_metrics(spark, sf_dir):
    metrics = ["l_quantity", "l_discount", "l_tax"]
    li = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *metrics)
    return D.rounded(li.unpivot(["l_orderkey", "l_linenumber"], metrics, "metric", "value"))


@query("union_frames", "SELECT 'supplier' AS family, s_suppkey AS key, s_acctbal AS balance FROM supplier UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer")
def union_frames(spark, sf_dir):
    s = D.table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("family"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    c = D.table(spark, sf_dir, "customer").select(F.lit("customer").alias("family"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return s.unionByName(c)


@query("except_keys", "SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0")
def except_keys(spark, sf_dir):
    some = D.table(spark, sf_dir, "orders").filter(F.col("o_custkey") % 3 == 0).select(F.col("o_custkey").alias("c_custkey"))
    return D.table(spark, sf_dir, "customer").select("c_custkey").exceptAll(some)


@query("domain_order", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY o_orderpriority ORDER BY list_position(['5-LOW', '1-URGENT', '2-HIGH'], o_orderpriority)")
def domain_order(spark, sf_dir):
    n = D.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return reshape.in_domain_order(n, "o_orderpriority", ["5-LOW", "1-URGENT", "2-HIGH"])


@query("multi_key_sort", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def multi_key_sort(spark, sf_dir):
    return D.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy("c_nationkey", F.col("c_acctbal").desc(), "c_custkey")


@query("code_window_filter", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey BETWEEN 1 AND 12 AND c_acctbal > 0")
def code_window_filter(spark, sf_dir):
    return D.table(spark, sf_dir, "customer").filter(F.col("c_nationkey").between(1, 12) & (F.col("c_acctbal") > 0)).select("c_custkey", "c_nationkey")


@query(
    "file_name_parse",
    "SELECT regexp_extract(f, '^bat_120_([0-9]+)_([0-9]+)_([0-9]+)_200_([0-9]+)[.]csv$', 1)::INT AS global_index, regexp_extract(f, '^bat_120_([0-9]+)_([0-9]+)_([0-9]+)_200_([0-9]+)[.]csv$', 2)::INT AS action, regexp_extract(f, '^bat_120_([0-9]+)_([0-9]+)_([0-9]+)_200_([0-9]+)[.]csv$', 3)::INT AS participant, regexp_extract(f, '^bat_120_([0-9]+)_([0-9]+)_([0-9]+)_200_([0-9]+)[.]csv$', 4)::INT AS raw_length FROM (SELECT CASE WHEN event_id % 7 = 0 THEN 'other_' || event_id || '.csv' ELSE 'bat_120_' || event_id || '_' || (event_id % 6 + 1) || '_' || (event_id % 40 + 1) || '_200_' || (event_id % 260) || '.csv' END AS f FROM events) WHERE f LIKE 'bat%'",
)
def file_name_parse(spark, sf_dir):
    from curvestat.sources.coordinates import parse_names

    e = F.col("event_id")
    name = F.when(e % 7 == 0, F.concat(F.lit("other_"), e, F.lit(".csv"))).otherwise(F.concat(F.lit("bat_120_"), e, F.lit("_"), e % 6 + 1, F.lit("_"), e % 40 + 1, F.lit("_200_"), e % 260, F.lit(".csv")))
    return parse_names(D.table(spark, sf_dir, "events").select(name.alias("file_name"))).drop("file_name")


@query("json_scalars", "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_scalars(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return D.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("digests", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM documents")
def digests(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("joint_mapping", f"WITH {D.JOINTS_SQL}, n AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(JOINTS, 1)) + ") AS t(joint, label)) SELECT joint AS joint_index, label, count(*) AS rows, count(*) FILTER (zero) AS missing FROM zj JOIN n USING (joint) GROUP BY ALL")
def joint_mapping(spark, sf_dir):
    """Rows and missing triplets of each joint, under its label."""
    names = F.element_at(F.array(*[F.lit(n) for n in JOINTS]), F.col("joint"))
    j = D.joints(spark, sf_dir)
    return j.groupBy(F.col("joint").alias("joint_index"), names.alias("label")).agg(F.count("*").alias("rows"), F.count_if(is_zero()).alias("missing"))


@query("scalar_two_way_events", f"""WITH x AS (SELECT user_id AS athlete, event_type AS action, value AS y, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS trial FROM events),
ok AS (SELECT athlete FROM x GROUP BY athlete HAVING count(DISTINCT action) = (SELECT count(DISTINCT action) FROM x)), lim AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM x WHERE athlete IN (FROM ok) GROUP BY athlete, action)),
b AS (SELECT * FROM x, lim WHERE trial <= k AND athlete IN (FROM ok)), cells AS (SELECT athlete, action, avg(y) AS m, var_pop(y) * count(*) AS ss, count(*) AS r FROM b GROUP BY ALL),
ath AS (SELECT athlete, avg(m) AS m FROM cells GROUP BY 1), act AS (SELECT action, avg(m) AS m FROM cells GROUP BY 1), g AS (SELECT avg(m) AS m, sum(ss) AS sse, min(r) AS r FROM cells),
sp AS (SELECT count(*) AS p, var_pop(m) * count(*) AS v FROM ath), sa AS (SELECT count(*) AS a, var_pop(m) * count(*) AS v FROM act), si AS (SELECT sum((cells.m - ath.m - act.m + g.m) ^ 2) AS v FROM cells JOIN ath USING (athlete) JOIN act USING (action), g)
SELECT p, a, r, {r('(a * r * sp.v / (p - 1) - r * si.v / ((p - 1) * (a - 1))) / (a * r)', 'raw_athlete', 5)}, {r('(r * si.v / ((p - 1) * (a - 1)) - sse / (p * a * (r - 1))) / r', 'raw_action_athlete', 5)}, {r('sse / (p * a * (r - 1))', 'raw_residual', 5)} FROM sp, sa, si, g""")
def scalar_two_way_events(spark, sf_dir):
    from curvestat.operators import components as C

    e = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("athlete"), F.col("event_type").alias("action"), F.col("value").alias("y"), "ts", "event_id")
    actions = e.agg(F.count_distinct("action").alias("a"))
    full = e.groupBy("athlete").agg(F.count_distinct("action").alias("seen")).crossJoin(F.broadcast(actions)).filter("seen = a").select("athlete")
    ranked = windows.trial_rank(e.join(full, "athlete", "left_semi"), ["athlete", "action"], ["ts", "event_id"])
    t = C.two_way(D._balanced(ranked, ["athlete", "action"]), [])
    return D.rounded(t.select("p", "a", "r", "raw_athlete", "raw_action_athlete", "raw_residual"), 5)
