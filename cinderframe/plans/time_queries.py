"""Time-series operators over the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.operators import timeseries as ts


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("minute", ts.minutes("ts"))


def _of(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("event_type") == kind)


def q_asof_last(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return ts.asof_last(_of(e, "view").select("user_id", "minute", "value"), _of(e, "purchase").select("event_id", "user_id", "minute"), ["user_id"], "minute", "value").select("event_id", "user_id", "value")


def q_asof_interp(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    out = ts.asof_linear(_of(e, "view").select("user_id", "minute", "value"), _of(e, "purchase").select("event_id", "user_id", "minute"), ["user_id"], "minute", "value")
    return out.select("event_id", F.round("value", 6).alias("value"))


def q_nearest_time(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return ts.nearest(_of(e, "view").select("user_id", "minute", F.col("event_id").alias("view_id")), _of(e, "purchase").select("event_id", "user_id", "minute"), ["user_id"], "minute", "view_id").select("event_id", "view_id")


def q_overlay(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    out = ts.overlay(_of(e, "click").select("event_id", "user_id", "minute", "value"), _of(e, "view").select("user_id", "minute", "value"), ["user_id"], "minute", "value")
    return out.select("event_id", "replaced", F.round("value", 6).alias("value"))


def q_band_join(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", "user_id", "minute", "event_type")
    pairs = ts.band_join(_of(e, "purchase"), _of(e, "view"), ["user_id"], "minute", 600.0)
    return pairs.groupBy(F.col("l.event_id").alias("event_id")).agg(F.count("*").alias("n_near"), F.min("r.event_id").alias("first_near"))


def q_cadence(spark: SparkSession, d: str) -> DataFrame:
    out = ts.cadence(_events(spark, d), ["user_id"], "minute", "event_id")
    return out.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("q10", "median", "q90", "le18", "le30", "gt36")])


def q_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = ts.with_gap(_events(spark, d), ["user_id"], "minute", "event_id")
    return g.groupBy("user_id").agg(F.count_if(F.col("gap") > 720).alias("n_gaps"), F.round(F.max("gap"), 6).alias("longest"))


def q_islands(spark: SparkSession, d: str) -> DataFrame:
    return ts.longest_run(_events(spark, d), ["user_id"], "minute", "event_id", 60.0, 2160.0)


def q_contiguous_blocks(spark: SparkSession, d: str) -> DataFrame:
    return ts.hour_blocks(_events(spark, d), ["event_type"], "ts").withColumn("block", F.col("block").cast("long"))


def q_monotone_fraction(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    out = ts.monotone_fraction(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.select("o_custkey", "n", F.round("monotone", 6).alias("monotone"))


def q_first_frame(spark: SparkSession, d: str) -> DataFrame:
    return ts.first_true(_events(spark, d), ["user_id"], "event_id", F.col("value") > 100)


def q_daily_rolling(spark: SparkSession, d: str) -> DataFrame:
    daily = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"), F.max("value").alias("high"), F.min("value").alias("low"))
    out = ts.trailing(ts.trailing(daily, ["user_id"], "day", "total", 7, "sum7"), ["user_id"], "day", "total", 28, "mean28", "mean")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("sum7", 6).alias("sum7"), F.round("mean28", 6).alias("mean28"))


def q_growing_season(spark: SparkSession, d: str) -> DataFrame:
    from cinderframe.functions.weather import day_length_hours, ramp, vapour_pressure_deficit_pa

    e = spark.read.parquet(f"{d}/events.parquet")
    warm = e.groupBy("user_id", F.to_date("ts").alias("day")).agg((F.min("value") / 10).alias("t_min"), F.max(vapour_pressure_deficit_pa(F.col("value") / 10, F.lit(40.0))).alias("vpd"))
    x = warm.withColumn("gsi", ramp(F.col("t_min"), -2.0, 5.0) * (1 - ramp(F.col("vpd"), 900.0, 4100.0)) * ramp(day_length_hours(F.lit(40.0), F.dayofyear("day")), 10.0, 11.0))
    out = ts.trailing(x, ["user_id"], "day", "gsi", 28, "mean28", "mean")
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("gsi", 6).alias("gsi"), F.round("mean28", 6).alias("mean28"))


def q_trim_window(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", "user_id", "minute")
    start = F.lit(28406880.0)  # 2024-01-05T00:00Z in minutes
    out = ts.trim(e, ["user_id"], "minute", start, start + 4320.0)
    return out.select("event_id", F.round("rebased", 6).alias("rebased"))


def q_discounted_return(spark: SparkSession, d: str) -> DataFrame:
    """Returns up to the first error, and without a stop."""
    e = spark.read.parquet(f"{d}/events.parquet")
    one = lambda done: ts.discounted_return(e, ["user_id"], F.to_date("ts"), ["ts", "event_id"], "value", 0.9, done)
    both = one(F.col("event_type") == "error").join(one(None).withColumnRenamed("ret", "unstopped"), "user_id")
    return both.select("user_id", F.round("ret", 6).alias("ret"), F.round("unstopped", 6).alias("unstopped"))


def q_gae(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("done", F.col("event_type") == "error").withColumn("guess", 50.0 + F.col("event_id") % 7)
    out = ts.advantages(e, ["user_id"], F.to_date("ts"), ["ts", "event_id"], "value", "guess", "done", 0.99, 0.95)
    return out.select("user_id", "event_id", F.round("advantage", 6).alias("advantage"))


def q_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a purchase and an error of one user whose windows of k minutes, times 30, overlap."""
    e = _events(spark, d).withColumn("until", F.col("minute") + 30 * F.get_json_object("props", "$.k").cast("double")).select("event_id", "user_id", "event_type", "minute", "until")
    pairs = ts.overlapping(_of(e, "purchase"), _of(e, "error"), ["user_id"], "minute", "until", 1440.0)
    return pairs.groupBy(F.col("l.event_id").alias("event_id")).agg(F.count("*").alias("n"), F.min("r.event_id").alias("first_error"))


def q_nearest_point(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's nearest supplier by balance and nation."""
    from cinderframe.operators.spatial import nearest_point
    from cinderframe.sources.tables import checkpoint_folder

    checkpoint_folder(spark)
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), (F.col("c_nationkey") * 4.0).alias("y"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") * 4.0).alias("y"))
    return nearest_point(c, s, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"))


QUERIES = {f.__name__: f for f in (q_asof_last, q_asof_interp, q_nearest_time, q_overlay, q_band_join, q_cadence, q_gaps, q_islands, q_contiguous_blocks, q_monotone_fraction, q_first_frame, q_daily_rolling, q_growing_season, q_trim_window, q_discounted_return, q_gae, q_interval_overlap, q_nearest_point)}

_M = "epoch_us(ts) / 60000000.0"
_BRACKET = f"""
WITH s AS (SELECT user_id, {_M} AS t, value, event_id FROM events WHERE event_type = 'view'),
q AS (SELECT event_id, user_id, {_M} AS t, value FROM events WHERE event_type = '{{kind}}'),
b AS (
  SELECT q.event_id, q.t, q.value AS own, x.t AS t0, x.value AS v0, x.event_id AS e0, y.t AS t1, y.value AS v1, y.event_id AS e1
  FROM q ASOF LEFT JOIN s x ON q.user_id = x.user_id AND q.t >= x.t
         ASOF LEFT JOIN s y ON q.user_id = y.user_id AND q.t < y.t)
"""
SQL = {
    "q_asof_last": f"""
WITH s AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT q.event_id, q.user_id, coalesce(s.value, f.value) AS value
FROM (SELECT * FROM events WHERE event_type = 'purchase') q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ts >= s.ts
LEFT JOIN (SELECT user_id, arg_min(value, ts) AS value FROM s GROUP BY user_id) f ON f.user_id = q.user_id
""",
    "q_asof_interp": _BRACKET.format(kind="purchase") + "SELECT event_id, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END, 6) AS value FROM b",
    "q_nearest_time": _BRACKET.format(kind="purchase") + "SELECT event_id, CASE WHEN t1 IS NULL OR (t0 IS NOT NULL AND t - t0 <= t1 - t) THEN e0 ELSE e1 END AS view_id FROM b",
    "q_overlay": _BRACKET.format(kind="click")
    + """, a AS (SELECT event_id, own, CASE WHEN t0 = t THEN v0 WHEN v1 IS NOT NULL THEN v0 + (t - t0) / (t1 - t0) * (v1 - v0) END AS av FROM b)
SELECT event_id, av IS NOT NULL AS replaced, round(coalesce(av, own), 6) AS value FROM a""",
    "q_band_join": f"""
SELECT p.event_id, count(*) AS n_near, min(v.event_id) AS first_near
FROM events p JOIN events v ON p.user_id = v.user_id AND abs(epoch_us(p.ts) / 60000000.0 - epoch_us(v.ts) / 60000000.0) <= 600
WHERE p.event_type = 'purchase' AND v.event_type = 'view' GROUP BY p.event_id
""",
    "q_cadence": f"""
WITH g AS (SELECT user_id, ({_M} - lag({_M}) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 60 AS h FROM events)
SELECT user_id, count(*) AS n, round(quantile_cont(h, 0.1), 6) AS q10, round(quantile_cont(h, 0.5), 6) AS median, round(quantile_cont(h, 0.9), 6) AS q90,
       round(avg((h <= 18)::INT), 6) AS le18, round(avg((h <= 30)::INT), 6) AS le30, round(avg((h > 36)::INT), 6) AS gt36
FROM g WHERE h IS NOT NULL GROUP BY user_id
""",
    "q_gaps": f"""
WITH g AS (SELECT user_id, {_M} - lag({_M}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(*) FILTER (gap > 720) AS n_gaps, round(max(gap), 6) AS longest FROM g GROUP BY user_id
""",
    "q_islands": f"""
WITH g AS (SELECT user_id, ts, event_id, {_M} - lag({_M}) OVER w AS gap, row_number() OVER w AS idx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, coalesce(gap BETWEEN 60 AND 2160, false) AS ok FROM g),
i AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM k),
r AS (SELECT user_id, island, count(*) AS run, min(idx) AS start FROM i WHERE ok GROUP BY ALL)
SELECT user_id, run, start FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run DESC, start) = 1
""",
    "q_contiguous_blocks": """
WITH h AS (SELECT DISTINCT event_type, (epoch_us(ts) // 3600000000)::BIGINT AS hour FROM events),
g AS (SELECT *, hour - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS g FROM h),
b AS (SELECT event_type, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS n FROM g GROUP BY event_type, g)
SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first_hour) AS block FROM b
""",
    "q_monotone_fraction": """
WITH p AS (SELECT o_custkey, o_totalprice AS v, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT o_custkey, count(*) AS n, round(coalesce(avg(CASE WHEN p IS NOT NULL THEN (v - p >= -greatest(5.0, 0.01 * p))::INT END), 1.0), 6) AS monotone FROM p GROUP BY o_custkey
""",
    "q_first_frame": "SELECT user_id, coalesce(min(event_id) FILTER (value > 100), -1) AS first_frame FROM events GROUP BY user_id",
    "q_daily_rolling": """
WITH d AS (SELECT user_id, ts::DATE AS day, sum(value) AS total FROM events GROUP BY ALL)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(sum(total) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS sum7,
       round(avg(total) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 6) AS mean28 FROM d
""",
    "q_growing_season": """
WITH d AS (
  SELECT user_id, ts::DATE AS day, min(value) / 10 AS t, max(610.94 * exp(17.625 * (value / 10) / (value / 10 + 243.04)) * 0.6) AS v FROM events GROUP BY ALL),
g AS (
  SELECT user_id, day, least(1, greatest(0, (t + 2) / 7)) * (1 - least(1, greatest(0, (v - 900) / 3200)))
         * least(1, greatest(0, (24 / pi() * acos(least(1, greatest(-1, -tan(radians(40)) * tan(0.409 * sin(2 * pi() * dayofyear(day) / 365 - 1.39))))) - 10) / 1)) AS gsi FROM d)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(gsi, 6) AS gsi,
       round(avg(gsi) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 6) AS mean28 FROM g
""",
    "q_trim_window": f"""
WITH e AS (SELECT event_id, user_id, {_M} AS t FROM events),
k AS (SELECT user_id, coalesce(max(t) FILTER (t <= 28406880), min(t)) AS a, coalesce(min(t) FILTER (t >= 28411200), max(t)) AS b FROM e GROUP BY user_id)
SELECT event_id, round(t - 28406880, 6) AS rebased FROM e JOIN k USING (user_id) WHERE t BETWEEN a AND b
""",
    "q_discounted_return": """
WITH o AS (
  SELECT user_id, value, row_number() OVER w - 1 AS k, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(sum(CASE WHEN ended = 0 THEN value * pow(0.9, k) ELSE 0 END), 6) AS ret, round(sum(value * pow(0.9, k)), 6) AS unstopped FROM o GROUP BY user_id
""",
    "q_gae": """
WITH RECURSIVE o AS (
  SELECT user_id, event_id, (event_type <> 'error')::INT AS go, value, 50.0::DOUBLE + event_id % 7 AS v, coalesce(lead(50.0::DOUBLE + event_id % 7) OVER w, 0) AS nxt,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT user_id, event_id, k, go, value + 0.99::DOUBLE * nxt * go - v AS delta FROM o),
a AS (SELECT user_id, event_id, k, delta AS adv FROM t WHERE k = 1 UNION ALL SELECT t.user_id, t.event_id, t.k, t.delta + 0.99::DOUBLE * 0.95::DOUBLE * t.go * a.adv FROM a JOIN t ON t.user_id = a.user_id AND t.k = a.k + 1)
SELECT user_id, event_id, round(adv, 6) AS advantage FROM a
""",
    "q_interval_overlap": f"""
WITH e AS (SELECT event_id, user_id, event_type, {_M} AS a, {_M} + 30 * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS b FROM events)
SELECT p.event_id, count(*) AS n, min(e.event_id) AS first_error FROM e p JOIN e ON p.user_id = e.user_id AND p.a < e.b AND e.a < p.b
WHERE p.event_type = 'purchase' AND e.event_type = 'error' GROUP BY p.event_id
""",
    "q_nearest_point": """
WITH d AS (SELECT c_custkey, s_suppkey, sqrt((c_acctbal / 100 - s_acctbal / 100) * (c_acctbal / 100 - s_acctbal / 100) + (c_nationkey * 4.0 - s_nationkey * 4.0) * (c_nationkey * 4.0 - s_nationkey * 4.0)::DOUBLE) AS d FROM customer, supplier)
SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, round(min(d), 6) AS distance FROM d GROUP BY c_custkey
""",
}
