"""Paired studies, summaries, scores and resampling over orders, line items, documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.functions.weather import circular_mean_deg
from cinderframe.operators import scoring, statistics as st

PAIR = ["o_custkey", "o_orderpriority"]


def _trials(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy(*PAIR, "o_orderstatus").agg(F.avg("o_totalprice").alias("loss"))


def _arm(trials: DataFrame, status: str) -> DataFrame:
    return trials.filter(F.col("o_orderstatus") == status)


def q_paired_policy(spark: SparkSession, d: str) -> DataFrame:
    t = _trials(spark, d)
    p = st.paired(_arm(t, "O"), _arm(t, "F"), PAIR, "loss")
    by_customer = p.groupBy("o_custkey").agg(F.avg("delta").alias("m"), F.sum("candidate").alias("c"), F.count("*").alias("n"), F.sum((F.col("delta") > 0).cast("int")).alias("won"))
    return by_customer.agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_clusters"), F.round(F.sum("c") / F.sum("n"), 4).alias("candidate_mean"), F.round(F.avg("m"), 4).alias("mean_improvement"), F.round(F.sum("won") / F.sum("n"), 6).alias("share_won"))


def q_paired_missing(spark: SparkSession, d: str) -> DataFrame:
    t = _trials(spark, d)
    return st.unpaired(_arm(t, "O"), _arm(t, "F"), PAIR).groupBy("side").agg(F.count("*").alias("n"))


def q_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return st.repeated_keys(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


def q_persistence_gain(spark: SparkSession, d: str) -> DataFrame:
    m = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_discount").alias("score"))
    return st.improvement_over(m, ["l_suppkey"], "l_returnflag", "N", "score").select("l_suppkey", "l_returnflag", F.round("gain", 6).alias("gain"))


def q_signed_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    return st.signed_pairs(o, ["o_custkey"], "o_orderstatus", "F", "O", "v").select("o_custkey", F.round("delta", 4).alias("delta"), "arms")


def q_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    out = st.cluster_mean(spark.read.parquet(f"{d}/lineitem.parquet"), "l_suppkey", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", "n_clusters", F.round("mean", 4).alias("mean"), F.round("weighted_mean", 4).alias("weighted_mean"))


def q_method_metric_matrix(spark: SparkSession, d: str) -> DataFrame:
    out = st.matrix(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("l_returnflag", "l_linestatus", "metric", "n", F.round("mean", 4).alias("mean"), "low", "high")


def q_rollup(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


def q_policy_spread(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy("o_orderstatus").agg(F.round(F.stddev_samp("o_totalprice"), 3).alias("sd_sample"), F.round(F.stddev_pop("o_totalprice"), 3).alias("sd_population"), F.round(F.avg((F.col("o_totalprice") > 250000).cast("double")), 6).alias("share_high"))


def q_ensemble_quantiles(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.avg("value").alias("mean"))
    return e.select("user_id", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("p10", "p50", "p90"))], F.round("mean", 6).alias("mean"))


def q_circular_mean(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("user_id").agg(F.round(circular_mean_deg(F.pmod("value", F.lit(360.0))), 6).alias("direction"))


def q_argmax_tie(spark: SparkSession, d: str) -> DataFrame:
    m = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("score"))
    return st.best_parameter(m, ["l_suppkey"], "l_linenumber", "score")


def q_log_weights(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", (-F.col("value") / 10).alias("lw"))
    return st.log_weights(e, ["user_id"], "lw").select("event_id", F.round("weight", 9).alias("weight"))


def q_resample(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.lit(1.0).alias("one"))
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    w = e.join(n, "user_id").withColumn("w", F.col("one") / F.col("n"))
    return st.resample(w, ["user_id"], "event_id", "w", 16, 0.37).groupBy("user_id").agg(F.sum("times").alias("drawn"), F.max("times").alias("most"))


def q_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    t = _trials(spark, d)
    clusters = st.paired(_arm(t, "O"), _arm(t, "F"), PAIR, "loss").groupBy("o_custkey").agg(F.avg("delta").alias("m"))
    out = st.interval(st.bootstrap(clusters, "m", "o_custkey", 200, 1, 256))
    return out.select(F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), F.round("above_zero", 6).alias("above_zero"))


def _forecasts(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    p = F.least(F.lit(1.0), F.col("n_chars") / 20000.0)
    return docs.select("doc_id", "lang", p.alias("p")).join(labels.select("doc_id", "quality", "toxic"), "doc_id")


def q_brier(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.proper_scores(_forecasts(spark, d), ["lang"], "p", "quality")
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("brier", "brier_event", "brier_other", "brier_balanced", "log_score", "ece")])


def q_reliability(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.reliability(_forecasts(spark, d), [], "p", "quality")
    return out.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("freq", 6).alias("freq"))


def q_bernoulli_weighted(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.weighted_scores(_forecasts(spark, d).withColumn("w", 1.0 - 0.5 * F.col("toxic")), ["lang"], "p", "quality", "w")
    return out.select("lang", F.round("log_likelihood", 6).alias("log_likelihood"), F.round("brier", 6).alias("brier"))


def q_soft_iou(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.soft_overlap(_forecasts(spark, d).withColumn("q", F.col("quality").cast("double")), ["lang"], "p", "q")
    return out.select("lang", F.round("soft_iou", 6).alias("soft_iou"), F.round("soft_brier", 6).alias("soft_brier"))


def q_censored(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    e = e.withColumn("hi", F.when(F.col("k") < 60, F.col("k") + 20))
    out = scoring.censored_loss(e, ["event_type"], "value", "k", "hi")
    return out.select("event_type", F.round("loss_seen", 6).alias("loss_seen"), F.round("loss_open", 6).alias("loss_open"))


QUERIES = {f.__name__: f for f in (q_paired_policy, q_paired_missing, q_duplicate_pairs, q_persistence_gain, q_signed_pairs, q_weighted_mean, q_method_metric_matrix, q_rollup, q_policy_spread, q_ensemble_quantiles, q_circular_mean, q_argmax_tie, q_log_weights, q_resample, q_bootstrap_ci, q_brier, q_reliability, q_bernoulli_weighted, q_soft_iou, q_censored)}

_TRIALS = """
WITH t AS (SELECT o_custkey, o_orderpriority, o_orderstatus, avg(o_totalprice) AS loss FROM orders GROUP BY ALL),
a AS (SELECT * FROM t WHERE o_orderstatus = 'O'), b AS (SELECT * FROM t WHERE o_orderstatus = 'F'),
p AS (SELECT o_custkey, o_orderpriority, a.loss AS control, b.loss AS candidate, b.loss - a.loss AS delta FROM a JOIN b USING (o_custkey, o_orderpriority)),
c AS (SELECT o_custkey, avg(delta) AS m, sum(candidate) AS c, count(*) AS n, sum((delta > 0)::INT) AS won FROM p GROUP BY o_custkey)
"""
_FORECAST = """
WITH f AS (SELECT doc_id, lang, least(1.0, n_chars / 20000.0) AS p0, quality, toxic FROM documents JOIN labels USING (doc_id)),
g AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p0)) AS p, quality::DOUBLE AS y FROM f),
h AS (SELECT *, least(9, (SELECT count(*) FROM range(1, 10) e(i) WHERE p >= i / 10.0::DOUBLE)) AS bin FROM g)
"""


def _mixed(x: str) -> str:
    step = "list_transform({0}, lambda v: xor(v, v >> 16) * 73244475 % 4294967296)"
    return f"list_transform({step.format(step.format(f'[({x}) % 4294967296]'))}, lambda v: xor(v, v >> 16))[1]"


def bootstrap_sql(seed: int, block: int, replicates: int) -> str:
    """CTEs from k (m, number) to s (replicate, mean)."""
    to, pick = _mixed(f"number * 7919 + replicate * 104729 + {seed}"), _mixed(f"{_mixed('j * 15485863 + replicate')} + h.block * 32452843 + {seed}")
    return f"""z AS (SELECT number // {block} AS block, count(*) AS m FROM k GROUP BY 1),
h AS (SELECT replicate, {to} % (SELECT count(*) FROM k) // {block} AS block, count(*) AS n FROM k, range({replicates}) t(replicate) GROUP BY ALL),
r AS (SELECT replicate, h.block * {block} + {pick} % z.m AS pick FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM h) h JOIN z ON z.block = h.block),
s AS (SELECT replicate, avg(k.m) AS mean FROM r JOIN k ON r.pick = k.number GROUP BY replicate)"""


SQL = {
    "q_paired_policy": _TRIALS + "SELECT sum(n)::BIGINT AS n_pairs, count(*) AS n_clusters, round(sum(c) / sum(n), 4) AS candidate_mean, round(avg(m), 4) AS mean_improvement, round(sum(won) / sum(n), 6) AS share_won FROM c",
    "q_paired_missing": _TRIALS
    + """SELECT 'control' AS side, count(*) AS n FROM a ANTI JOIN b USING (o_custkey, o_orderpriority) HAVING count(*) > 0
UNION ALL SELECT 'candidate', count(*) FROM b ANTI JOIN a USING (o_custkey, o_orderpriority) HAVING count(*) > 0""",
    "q_duplicate_pairs": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "q_persistence_gain": """
WITH m AS (SELECT l_suppkey, l_returnflag, avg(l_discount) AS score FROM lineitem GROUP BY ALL)
SELECT x.l_suppkey, x.l_returnflag, round(b.score - x.score, 6) AS gain FROM m x JOIN m b ON x.l_suppkey = b.l_suppkey AND b.l_returnflag = 'N' WHERE x.l_returnflag <> 'N'
""",
    "q_signed_pairs": "SELECT o_custkey, round(sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE -o_totalprice END), 4) AS delta, count(DISTINCT o_orderstatus) AS arms FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey",
    "q_weighted_mean": """
WITH e AS (SELECT l_returnflag, l_suppkey, avg(l_extendedprice) AS m, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, sum(n)::BIGINT AS n, count(*) AS n_clusters, round(sum(s) / sum(n), 4) AS mean, round(avg(m), 4) AS weighted_mean FROM e GROUP BY l_returnflag
""",
    "q_method_metric_matrix": """
WITH u AS (SELECT l_returnflag, l_linestatus, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS metric, unnest([l_quantity, l_extendedprice, l_discount]) AS v FROM lineitem)
SELECT l_returnflag, l_linestatus, metric, count(v) AS n, round(avg(v), 4) AS mean, min(v) AS low, max(v) AS high FROM u GROUP BY ALL
""",
    "q_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "q_policy_spread": "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 3) AS sd_sample, round(stddev_pop(o_totalprice), 3) AS sd_population, round(avg((o_totalprice > 250000)::INT), 6) AS share_high FROM orders GROUP BY o_orderstatus",
    "q_ensemble_quantiles": "SELECT user_id, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean FROM events GROUP BY user_id",
    "q_circular_mean": "WITH m AS (SELECT user_id, degrees(atan2(avg(sin(radians(value % 360))), avg(cos(radians(value % 360))))) AS a FROM events GROUP BY user_id) SELECT user_id, round(((a % 360) + 360) % 360, 6) AS direction FROM m",
    "q_argmax_tie": "WITH m AS (SELECT l_suppkey, l_linenumber, count(*) AS score FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_linenumber, score FROM m QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_linenumber) = 1",
    "q_log_weights": """
WITH w AS (SELECT event_id, user_id, exp(-value / 10 - max(-value / 10) OVER (PARTITION BY user_id)) AS w FROM events)
SELECT event_id, round(w / sum(w) OVER (PARTITION BY user_id), 9) AS weight FROM w
""",
    "q_resample": """
WITH n AS (SELECT event_id, user_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY user_id) AS w FROM events),
c AS (SELECT user_id, w, sum(w) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM n),
t AS (SELECT user_id, (least(ceil(hi * 16 - 0.37::DOUBLE), 16) - greatest(ceil((hi - w) * 16 - 0.37::DOUBLE), 0))::BIGINT AS times FROM c)
SELECT user_id, sum(times)::BIGINT AS drawn, max(times) AS most FROM t GROUP BY user_id
""",
    "q_bootstrap_ci": _TRIALS
    + """, k AS (SELECT m, row_number() OVER (ORDER BY o_custkey) - 1 AS number FROM c),
""" + bootstrap_sql(1, 256, 200)
    + """ SELECT round(quantile_cont(mean, 0.025), 3) AS low, round(quantile_cont(mean, 0.975), 3) AS high, round(avg((mean > 0)::INT), 6) AS above_zero FROM s""",
    "q_brier": _FORECAST
    + """, b AS (SELECT lang, bin, count(*) AS n, avg(p) AS mp, avg(y) AS f FROM h GROUP BY ALL),
e AS (SELECT lang, sum(n * abs(mp - f)) / sum(n) AS ece FROM b GROUP BY lang)
SELECT lang, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg((p - y) * (p - y)) FILTER (y = 1), 6) AS brier_event, round(avg((p - y) * (p - y)) FILTER (y = 0), 6) AS brier_other,
       round((avg((p - y) * (p - y)) FILTER (y = 1) + avg((p - y) * (p - y)) FILTER (y = 0)) / 2, 6) AS brier_balanced, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_score, round(any_value(ece), 6) AS ece
FROM h JOIN e USING (lang) GROUP BY lang""",
    "q_reliability": _FORECAST + "SELECT bin::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS freq FROM h GROUP BY bin",
    "q_bernoulli_weighted": _FORECAST
    + "SELECT lang, round(sum((1 - 0.5 * toxic) * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(1 - 0.5 * toxic), 6) AS log_likelihood, round(sum((1 - 0.5 * toxic) * (p - y) * (p - y)) / sum(1 - 0.5 * toxic), 6) AS brier FROM h GROUP BY lang",
    "q_soft_iou": _FORECAST + "SELECT lang, round(sum(least(p0, y)) / greatest(sum(greatest(p0, y)), 1e-12), 6) AS soft_iou, round(avg((p0 - y) * (p0 - y)), 6) AS soft_brier FROM h GROUP BY lang",
    "q_censored": """
WITH e AS (SELECT event_type, value AS t, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS a FROM events),
f AS (SELECT *, CASE WHEN a < 60 THEN a + 20 END AS b FROM e),
g AS (SELECT *, CASE WHEN t < a THEN a - t WHEN b IS NOT NULL AND t > b THEN t - b ELSE 0 END AS loss FROM f)
SELECT event_type, round(avg(loss) FILTER (b IS NOT NULL), 6) AS loss_seen, round(avg(loss) FILTER (b IS NULL), 6) AS loss_open FROM g GROUP BY event_type
""",
}
