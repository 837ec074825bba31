"""Profiles, strict joins, lookups and summaries over orders, line items, labels and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.operators import profile as pf


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id", "left")


def q_null_profile(spark: SparkSession, d: str) -> DataFrame:
    return pf.profile(_labelled(spark, d), ["quality"], ["n_chars"], ["toxic", "lang"]).withColumn("share_toxic", F.round("share_toxic", 6))


def q_labelled_counts(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    return pf.labelled_counts(_labelled(spark, d), label, F.when(F.col("n_chars") > 1000, F.col("n_chars"))).withColumn("stamped_share", F.round("stamped_share", 6))


def q_overlap_shares(spark: SparkSession, d: str) -> DataFrame:
    flags = {"closed": F.col("o_orderstatus") == "F", "dear": F.col("o_totalprice") > 250_000, "early": F.month("o_orderdate") <= 3}
    out = pf.overlap_shares(_read(spark, d, "orders").withColumn("none", F.col("o_orderkey") % 2 == 0), ["o_orderpriority", "none"], flags | {"odd": ~F.col("none")}, "odd")
    return out.select(*out.columns[:6], *[F.round(c, 6).alias(c) for c in out.columns[6:]])


def q_missing_census(spark: SparkSession, d: str) -> DataFrame:
    return pf.missing_census(_labelled(spark, d), ["text", "lang", "source", "quality", "toxic"])


def q_counts_with_zeros(spark: SparkSession, d: str) -> DataFrame:
    return pf.counts_with_zeros(_read(spark, d, "part"), F.array_append(F.split("p_name", " "), F.col("p_type")), ["ECONOMY", "widget", "cold", "absent", "PROMO"])


def q_latency(spark: SparkSession, d: str) -> DataFrame:
    out = pf.latency(_read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.withColumn("per_second", F.round("per_second", 8))


def q_summary(spark: SparkSession, d: str) -> DataFrame:
    out = pf.summary(_read(spark, d, "orders"), ["o_orderpriority"], "o_custkey", "o_totalprice")
    return out.select("o_orderpriority", "n", "n_clusters", *[F.round(c, 3).alias(c) for c in ("mean", "median", "weighted_mean")])


def q_cluster_spread(spark: SparkSession, d: str) -> DataFrame:
    out = pf.cluster_spread(_read(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "l_quantity")
    return out.select("l_returnflag", "n_clusters", *[F.round(c, 6).alias(c) for c in ("mean", "median", "sd")])


def q_strict_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").groupBy("o_custkey")
    out = pf.strictly_paired(o.agg(F.min("o_totalprice").alias("v")), o.agg(F.max("o_totalprice").alias("v")), ["o_custkey"], "v")
    return out.withColumn("delta", F.round("delta", 3))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    lines = o.filter("o_orderstatus = 'F' and o_totalprice > 300000").groupBy("o_orderpriority", "month").agg(F.max("o_totalprice").alias("line"))
    return pf.with_active(o.select("o_orderpriority", "month").distinct(), lines, ["o_orderpriority"], "month", "line")


def q_active_lines(spark: SparkSession, d: str) -> DataFrame:
    return _frames(spark, d)


def q_missing_times(spark: SparkSession, d: str) -> DataFrame:
    out = pf.missing_times(_frames(spark, d), ["o_orderpriority"], "month", "line")
    return out.select("o_orderpriority", "n_frames", "n_missing", F.array_join("missing", ",").alias("missing"), F.round("covered", 6).alias("covered"))


def q_lookup_default(spark: SparkSession, d: str) -> DataFrame:
    table = _read(spark, d, "region").select(F.col("r_regionkey").alias("l_linenumber"), (F.col("r_regionkey") * 1.5 + 0.5).alias("load"), F.col("r_name").alias("label"))
    out = pf.looked_up(_read(spark, d, "lineitem"), table, "l_linenumber", {"load": 0.0, "label": "none"})
    return out.groupBy("l_linenumber", "label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("load") * F.col("l_quantity")), 3).alias("total"))


def q_dangling(spark: SparkSession, d: str) -> DataFrame:
    known = _read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = _read(spark, d, "orders")
    out = pf.dangling(o, F.array(F.col("o_custkey"), F.col("o_custkey") * 2, F.col("o_custkey") + 100), known, "k", "o_orderkey")
    return out.select("o_orderkey", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


def q_signature(spark: SparkSession, d: str) -> DataFrame:
    work = lambda s: s.withColumn("model", F.pow(1 + F.col("l_discount"), F.col("l_linenumber")) * (1 + F.col("l_tax")))
    out = pf.by_signature(_read(spark, d, "lineitem"), ["l_discount", "l_tax", "l_linenumber"], work, "sharers")
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("model"), 4).alias("total"), F.max("sharers").alias("most"))


def q_listed(spark: SparkSession, d: str) -> DataFrame:
    out = pf.listed(_read(spark, d, "part"), ["p_type"], "p_brand")
    return out.select("p_type", "n", F.array_join("values", ",").alias("brands"))


def q_step_quantiles(spark: SparkSession, d: str) -> DataFrame:
    out = pf.step_quantiles(_read(spark, d, "part").withColumn("step", F.floor(F.col("p_partkey") / 40)), ["step"], "p_retailprice")
    return out.select("step", *[F.round(c, 5).alias(c) for c in ("mean", "q10", "q90")])


def q_filled_segments(spark: SparkSession, d: str) -> DataFrame:
    loads = _read(spark, d, "lineitem").filter("l_suppkey % 3 <> 0").withColumnRenamed("l_suppkey", "s_suppkey")
    out = pf.filled_segments(loads, _read(spark, d, "supplier"), ["s_suppkey"], "l_quantity", "s_acctbal")
    return out.select("s_suppkey", F.round("used", 4).alias("used"), F.round("wasted", 4).alias("wasted"))


def q_split_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Records of two methods and their split put under each other, then summarised by metric, weighted by cluster and plain."""
    li = _read(spark, d, "lineitem").withColumn("split", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("tune"))
    one = lambda flag, name: li.filter(F.col("l_returnflag") == flag).select("split", "l_suppkey", F.lit(name).alias("method"), "l_quantity", "l_discount")
    both = one("N", "raw").unionByName(one("R", "fitted"))
    long = both.unpivot(["split", "method", "l_suppkey"], ["l_quantity", "l_discount"], "metric", "v")
    out = pf.summary(long, ["split", "method", "metric"], "l_suppkey", "v")
    return out.select("split", "method", "metric", "n", "n_clusters", *[F.round(c, 6).alias(c) for c in ("mean", "median", "weighted_mean")])


def q_active_growth(spark: SparkSession, d: str) -> DataFrame:
    """Rows with growth inside a nested record, without the record."""
    e = _read(spark, d, "events").withColumn("forecast", F.from_json("props", "struct<k:int>"))
    return e.filter("forecast.k > 50").drop("forecast", "props", "ts").withColumn("value", F.round("value", 4))


QUERIES = {f.__name__: f for f in (q_null_profile, q_labelled_counts, q_overlap_shares, q_missing_census, q_counts_with_zeros, q_latency, q_summary, q_cluster_spread, q_strict_pairs, q_active_lines, q_missing_times, q_lookup_default, q_dangling, q_signature, q_listed, q_step_quantiles, q_filled_segments, q_split_matrix, q_active_growth)}

_FRAMES = """
o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
f AS (SELECT DISTINCT o_orderpriority, month FROM o),
l AS (SELECT o_orderpriority, month, max(o_totalprice) AS line FROM o WHERE o_orderstatus = 'F' AND o_totalprice > 300000 GROUP BY ALL),
x AS (SELECT f.o_orderpriority, f.month, l.line FROM f LEFT JOIN l USING (o_orderpriority, month))
"""
SQL = {
    "q_null_profile": "SELECT quality, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS sum_n_chars, count(toxic) AS n_toxic, count(DISTINCT toxic) AS distinct_toxic, round(count(toxic) / count(*), 6) AS share_toxic, count(lang) AS n_lang, count(DISTINCT lang) AS distinct_lang, count(lang) / count(*) AS share_lang FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality",
    "q_labelled_counts": "SELECT CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'unknown' END AS label, count(*) AS n, round(count(*) FILTER (n_chars > 1000) / count(*), 6) AS stamped_share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "q_overlap_shares": """
WITH o AS (SELECT o_orderpriority, o_orderkey % 2 = 0 AS none, o_orderstatus = 'F' AS closed, o_totalprice > 250000 AS dear, month(o_orderdate) <= 3 AS early FROM orders)
SELECT o_orderpriority, none, count(*) FILTER (closed) AS n_closed, count(*) FILTER (dear) AS n_dear, count(*) FILTER (early) AS n_early, count(*) FILTER (NOT none) AS n_odd,
       CASE WHEN NOT none THEN round(count(*) FILTER (closed) / count(*), 6) END AS share_closed, CASE WHEN NOT none THEN round(count(*) FILTER (dear) / count(*), 6) END AS share_dear,
       CASE WHEN NOT none THEN round(count(*) FILTER (early) / count(*), 6) END AS share_early
FROM o GROUP BY o_orderpriority, none
""",
    "q_missing_census": """
WITH x AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT count(*) AS n FROM x)
SELECT 'text' AS field, count(*) FILTER (text IS NULL) AS n_missing, count(*) AS n FROM x UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL), count(*) FROM x
UNION ALL SELECT 'source', count(*) FILTER (source IS NULL), count(*) FROM x UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL), count(*) FROM x
UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), count(*) FROM x
""",
    "q_counts_with_zeros": """
WITH e AS (SELECT unnest(list_append(string_split(p_name, ' '), p_type)) AS value FROM part), g AS (SELECT value, count(*) AS n FROM e GROUP BY value),
k AS (SELECT unnest(['ECONOMY', 'widget', 'cold', 'absent', 'PROMO']) AS value)
SELECT coalesce(k.value, g.value) AS value, coalesce(n, 0) AS n FROM k FULL JOIN g ON k.value = g.value
""",
    "q_latency": "SELECT l_returnflag, count(*) AS n, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, quantile_disc(l_quantity, 0.99) AS p99, round(count(*) / sum(l_quantity), 8) AS per_second FROM lineitem GROUP BY l_returnflag",
    "q_summary": """
WITH c AS (SELECT o_orderpriority, o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY ALL), w AS (SELECT o_orderpriority, count(*) AS n_clusters, avg(m) AS wm FROM c GROUP BY ALL)
SELECT o_orderpriority, count(*) AS n, any_value(n_clusters) AS n_clusters, round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 3) AS median, round(any_value(wm), 3) AS weighted_mean
FROM orders JOIN w USING (o_orderpriority) GROUP BY o_orderpriority
""",
    "q_cluster_spread": """
WITH c AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS n_clusters, round(avg(m), 6) AS mean, round(median(m), 6) AS median, round(stddev_pop(m), 6) AS sd FROM c GROUP BY l_returnflag
""",
    "q_strict_pairs": "SELECT o_custkey, min(o_totalprice) AS control, max(o_totalprice) AS candidate, round(max(o_totalprice) - min(o_totalprice), 3) AS delta FROM orders GROUP BY o_custkey",
    "q_active_lines": f"WITH {_FRAMES} SELECT * FROM x",
    "q_missing_times": f"""
WITH {_FRAMES}
SELECT o_orderpriority, count(*) AS n_frames, count(*) FILTER (line IS NULL) AS n_missing, coalesce(string_agg(month, ',' ORDER BY month) FILTER (line IS NULL), '') AS missing, round(count(line) / count(*), 6) AS covered
FROM x GROUP BY o_orderpriority
""",
    "q_lookup_default": """
SELECT l_linenumber, coalesce(r_name, 'none') AS label, count(*) AS n, round(sum(coalesce(r_regionkey * 1.5::DOUBLE + 0.5, 0) * l_quantity), 3) AS total
FROM lineitem LEFT JOIN region ON r_regionkey = l_linenumber GROUP BY ALL
""",
    "q_dangling": """
WITH r AS (SELECT DISTINCT o_orderkey, unnest([o_custkey, o_custkey * 2, o_custkey + 100]) AS k FROM orders)
SELECT o_orderkey, string_agg(k::VARCHAR, ',' ORDER BY k) AS missing FROM r WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY o_orderkey
""",
    "q_signature": """
WITH x AS (SELECT *, pow(1 + l_discount, l_linenumber) * (1 + l_tax) AS model, count(*) OVER (PARTITION BY l_discount, l_tax, l_linenumber) AS sharers FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(sum(model), 4) AS total, max(sharers) AS most FROM x GROUP BY l_returnflag
""",
    "q_listed": "SELECT p_type, count(*) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY p_type",
    "q_step_quantiles": "SELECT p_partkey // 40 AS step, round(avg(p_retailprice), 5) AS mean, round(quantile_cont(p_retailprice, 0.1), 5) AS q10, round(quantile_cont(p_retailprice, 0.9), 5) AS q90 FROM part GROUP BY ALL",
    "q_filled_segments": """
WITH g AS (SELECT l_suppkey, sum(l_quantity) AS a FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY l_suppkey),
x AS (SELECT s_suppkey, coalesce(a, 0) AS a, least(coalesce(a, 0), greatest(s_acctbal, 0)) AS used FROM supplier LEFT JOIN g ON l_suppkey = s_suppkey)
SELECT s_suppkey, round(used, 4) AS used, round(a - used, 4) AS wasted FROM x
""",
    "q_split_matrix": """
WITH b AS (
  SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'tune' END AS split, CASE l_returnflag WHEN 'N' THEN 'raw' ELSE 'fitted' END AS method, l_suppkey, l_quantity, l_discount FROM lineitem WHERE l_returnflag IN ('N', 'R')),
l AS (SELECT split, method, l_suppkey, 'l_quantity' AS metric, l_quantity AS v FROM b UNION ALL SELECT split, method, l_suppkey, 'l_discount', l_discount FROM b),
c AS (SELECT split, method, metric, l_suppkey, avg(v) AS m FROM l GROUP BY ALL), w AS (SELECT split, method, metric, count(*) AS k, avg(m) AS wm FROM c GROUP BY ALL)
SELECT split, method, metric, count(*) AS n, any_value(k) AS n_clusters, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(any_value(wm), 6) AS weighted_mean
FROM l JOIN w USING (split, method, metric) GROUP BY split, method, metric
""",
    "q_active_growth": "SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events WHERE CAST(props->>'k' AS INT) > 50",
}
