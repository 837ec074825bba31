"""Fuel moisture along the events of each user as weather samples, and small summaries of studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.functions import weather as wx
from cinderframe.operators import fuel, statistics as st, timeseries as ts


def _weather(spark: SparkSession, d: str) -> DataFrame:
    """One sample a user and minute: temperature, humidity and rain from the event's value and payload."""
    e = spark.read.parquet(f"{d}/events.parquet")
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    e = e.groupBy("user_id", minute.alias("minute")).agg(F.min("value").alias("v"), F.max(F.get_json_object("props", "$.k").cast("double")).alias("k"))
    return e.select("user_id", "minute", F.timestamp_seconds(F.col("minute") * 60).alias("ts"), (F.col("v") % 35).alias("celsius"), F.col("k").alias("humidity"), F.when(F.col("k") > 90, (F.col("k") - 90) / 4).otherwise(0.0).alias("rain"))


def q_dead_moisture(spark: SparkSession, d: str) -> DataFrame:
    out = fuel.dead_moisture(_weather(spark, d), ["user_id"], "minute", "celsius", "humidity", "rain", 10.0)
    return out.select("user_id", "minute", F.round("moisture", 7).alias("moisture"))


def q_equilibria(spark: SparkSession, d: str) -> DataFrame:
    x = _weather(spark, d)
    up, low = wx.moisture_equilibria(F.col("celsius"), F.col("humidity"))
    t, h = wx.downscaled(F.col("celsius"), F.col("humidity"), F.col("user_id") * 20.0, F.lit(1000.0))
    return x.select("user_id", "minute", *[F.round(c, 8).alias(n) for n, c in (("upper", up), ("lower", low), ("celsius", t), ("humidity", h), ("curing", wx.curing_fraction(F.col("humidity") / 50)))])


def q_local_days(spark: SparkSession, d: str) -> DataFrame:
    out = fuel.local_days(_weather(spark, d), ["user_id"], "ts", "celsius", "humidity", "rain", -120.5)
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.round(c, 6).alias(c) for c in ("t_min", "vpd_max", "rain")])


def q_live_moisture(spark: SparkSession, d: str) -> DataFrame:
    days = fuel.local_days(_weather(spark, d), ["user_id"], "ts", "celsius", "humidity", "rain", -120.5)
    out = fuel.live_moisture(days.withColumn("t_min", F.col("t_min") + 4).withColumn("day", F.date_add("day", 120)), ["user_id"], 38.5)
    return out.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.round(c, 7).alias(c) for c in ("gsi", "herbaceous", "woody")])


def q_nearest_axis(spark: SparkSession, d: str) -> DataFrame:
    """The grid cell of each station: per axis the nearest value, of equals the first."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") * 7.3 % 40).alias("px"), (F.col("s_suppkey") * 3.1 % 20).alias("py"))
    axis = lambda step, n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((i * step).alias("at"), i.alias("i")))
    near = lambda p, a: F.array_min(F.transform(a, lambda e: F.struct(F.abs(e["at"] - p).alias("gap"), e["i"].alias("i"))))["i"]
    return s.select("s_suppkey", near(F.col("px"), axis(2.5, 15)).alias("x"), near(F.col("py"), axis(1.25, 15)).alias("y"))


def q_rotation_spread(spark: SparkSession, d: str) -> DataFrame:
    """Population deviation over mean of areas and extents, by heading; canonical fractions beside them."""
    p = spark.read.parquet(f"{d}/part.parquet").groupBy((F.col("p_partkey") % 8).alias("heading"), "p_type").agg(F.sum("p_size").alias("area"), F.max("p_retailprice").alias("extent"), F.count_if(F.col("p_size") > 25).alias("burned"), F.count("*").alias("cells"))
    ratio = lambda c: F.round(F.stddev_pop(c) / F.avg(c), 8).alias(f"{c}_spread")
    return p.groupBy("p_type").agg(ratio("area"), ratio("extent"), F.max("extent").alias("top"), F.round(F.sum("burned") / F.greatest(F.sum("cells"), F.lit(1)), 6).alias("fraction"))


def q_policy_means(spark: SparkSession, d: str) -> DataFrame:
    """Counterfactual summary: means by policy and how far each is from the reference policy's."""
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus", "o_custkey").agg(F.avg("o_totalprice").alias("loss"), F.count("*").alias("steps"))
    means = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg("loss").alias("loss"), F.avg("steps").alias("steps"))
    ref = means.filter("o_orderstatus = 'O'").select(F.col("loss").alias("ref"))
    return means.crossJoin(F.broadcast(ref)).select("o_orderstatus", "n", F.round("loss", 3).alias("loss"), F.round("steps", 6).alias("steps"), F.round(st.skill(F.col("loss"), F.col("ref")), 8).alias("skill"))


def q_area_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Area of polygons by the shoelace formula beside that of their cells: median ratio and greatest error by region."""
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("w", F.col("n_nationkey") % 7 + 3.3).withColumn("h", F.col("n_nationkey") % 4 + 2.6)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    n = n.withColumn("p", F.array(corner(zero, zero), corner(F.col("w"), zero), corner(F.col("w"), F.col("h")), corner(zero, F.col("h") / 2)))
    turn = F.transform("p", lambda a, i: a.x * F.element_at("p", F.when(i == 3, 1).otherwise(i + 2)).y - F.element_at("p", F.when(i == 3, 1).otherwise(i + 2)).x * a.y)
    n = n.withColumn("exact", F.abs(F.aggregate(turn, zero, lambda a, b: a + b)) / 2)
    cells = n.withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(10)))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(6))))
    under = (F.col("cx") + 0.5 < F.col("w")) & (F.col("cy") + 0.5 < F.col("h") / 2 + F.col("h") / 2 * (F.col("cx") + 0.5) / F.col("w"))
    ratio = cells.groupBy("n_regionkey", "n_nationkey").agg((F.count_if(under) / F.max("exact")).alias("ratio"))
    return ratio.groupBy("n_regionkey").agg(F.round(F.median("ratio"), 7).alias("median"), F.round(F.max(F.abs(F.col("ratio") - 1)), 7).alias("worst"))


def q_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Observations in the order of their schedule though they come in another: those due by each tick, the last one first seen."""
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'click'")
    late = F.get_json_object("props", "$.k").cast("int")
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    x = e.select("user_id", "event_id", minute.alias("at"), (F.ceil((minute + late) / 720) * 720).alias("tick"))
    out = x.groupBy("user_id", "tick").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("at", "event_id")).alias("last"))
    return out.withColumn("n_so_far", F.sum("n").over(ts.Window.partitionBy("user_id").orderBy("tick")))


QUERIES = {f.__name__: f for f in (q_dead_moisture, q_equilibria, q_local_days, q_live_moisture, q_nearest_axis, q_rotation_spread, q_policy_means, q_area_ratio, q_schedule)}

_W = """
w AS (
  SELECT user_id, m AS minute, v % 35 AS c, k AS h, CASE WHEN k > 90 THEN (k - 90) / 4 ELSE 0 END AS r
  FROM (SELECT user_id, epoch_us(ts) // 60000000 AS m, min(value) AS v, max(CAST(props->>'k' AS DOUBLE)) AS k FROM events GROUP BY ALL))"""


def _equilibria(c: str, h: str) -> tuple[str, str]:
    heat = f"0.18::DOUBLE * (21.1::DOUBLE - {c}) * (1 - exp(-0.115::DOUBLE * {h}))"
    dry = f"0.942::DOUBLE * pow({h}, 0.679::DOUBLE) + 0.4994e-4 * exp(0.1::DOUBLE * {h}) + {heat}"
    wet = f"0.618::DOUBLE * pow({h}, 0.753::DOUBLE) + 0.4540e-4 * exp(0.1::DOUBLE * {h}) + {heat}"
    return tuple(f"least(3, greatest(0, {f}({dry}, {wet}) * 0.01::DOUBLE))" for f in ("greatest", "least"))


_UP, _LOW = _equilibria("c", "h")
_MUP, _MLOW = _equilibria("mc", "mh")
_VP = "610.94::DOUBLE * exp(17.625::DOUBLE * ({0}) / (({0}) + 243.04::DOUBLE))"
_DAYS = f"""
s AS (SELECT *, coalesce(minute - lag(minute) OVER u, lead(minute) OVER u - minute, 60) / 60.0::DOUBLE AS hours, (make_timestamp((minute * 60000000 - 28920000000)::BIGINT))::DATE AS day FROM w WINDOW u AS (PARTITION BY user_id ORDER BY minute)),
d AS (SELECT user_id, day, min(c) AS t_min, max({_VP.format("c")} * (1 - h / 100)) AS vpd_max, sum(r * hours) AS rain FROM s GROUP BY user_id, day)"""
SQL = {
    "q_dead_moisture": f"""
WITH RECURSIVE {_W}, o AS (SELECT *, row_number() OVER u AS n, (c + lag(c) OVER u) / 2 AS mc, (h + lag(h) OVER u) / 2 AS mh, (r + lag(r) OVER u) / 2 AS mr, minute - lag(minute) OVER u AS dt FROM w WINDOW u AS (PARTITION BY user_id ORDER BY minute)),
e AS (SELECT user_id, minute, n, ({_UP} + {_LOW}) / 2 AS start, {_MUP} AS up, {_MLOW} AS low, greatest(mr - 0.05::DOUBLE, 0) AS x, dt FROM o),
m AS (
  SELECT user_id, minute, n, start AS m FROM e WHERE n = 1 UNION ALL
  SELECT e.user_id, e.minute, e.n, least(3, greatest(0, m.m + (CASE WHEN x > 0 THEN 2.5::DOUBLE ELSE greatest(least(m.m, up), low) END - m.m)
    * (1 - exp(-dt * CASE WHEN x > 0 THEN (1 - exp(-x / 8)) / 8400 ELSE 1 / 600.0::DOUBLE END)))) FROM m JOIN e ON e.user_id = m.user_id AND e.n = m.n + 1)
SELECT user_id, minute, round(m, 7) AS moisture FROM m
""",
    "q_equilibria": f"""
WITH {_W}, t AS (SELECT *, c - 0.0065::DOUBLE * (user_id * 20 - 1000) AS tc FROM w)
SELECT user_id, minute, round({_UP}, 8) AS upper, round({_LOW}, 8) AS lower, round(tc, 8) AS celsius, round(least(100, greatest(0, h * {_VP.format("c")} / ({_VP.format("tc")}))), 8) AS humidity, round(least(1, greatest(0, (1.2::DOUBLE - h / 50) / 0.9::DOUBLE)), 8) AS curing FROM t
""",
    "q_local_days": f"WITH {_W}, {_DAYS} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(t_min, 6) AS t_min, round(vpd_max, 6) AS vpd_max, round(rain, 6) AS rain FROM d",
    "q_live_moisture": f"""
WITH {_W}, {_DAYS},
f AS (SELECT user_id, day + 120 AS day, t_min + 4 AS t, vpd_max AS v, sum(rain) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS rain FROM d),
i AS (
  SELECT user_id, day, least(1, greatest(0, (t + 2) / 7)) * (1 - least(1, greatest(0, (v - 900) / 3200))) * least(1, greatest(0, rain / 10))
    * least(1, greatest(0, (86400 / pi() * acos(least(1, greatest(-1, -tan(radians(38.5)) * tan(0.409 * sin(2 * pi() * dayofyear(day) / 365 - 1.39))))) - 36000) / 3600)) AS x FROM f),
g AS (SELECT user_id, day, avg(x) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS gsi FROM i)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(gsi, 7) AS gsi, round(0.3::DOUBLE + 2.2::DOUBLE * least(1, greatest(0, (gsi - 0.2) / 0.8)), 7) AS herbaceous, round(0.6::DOUBLE + 1.4::DOUBLE * least(1, greatest(0, (gsi - 0.2) / 0.8)), 7) AS woody FROM g
""",
    "q_nearest_axis": """
WITH s AS (SELECT s_suppkey, s_suppkey * 7.3::DOUBLE % 40 AS px, s_suppkey * 3.1::DOUBLE % 20 AS py FROM supplier)
SELECT s_suppkey, (SELECT i FROM range(16) r(i) ORDER BY abs(i * 2.5::DOUBLE - px), i LIMIT 1)::INT AS x, (SELECT i FROM range(16) r(i) ORDER BY abs(i * 1.25::DOUBLE - py), i LIMIT 1)::INT AS y FROM s
""",
    "q_rotation_spread": """
WITH h AS (SELECT p_partkey % 8 AS heading, p_type, sum(p_size) AS area, max(p_retailprice) AS extent, count(*) FILTER (p_size > 25) AS burned, count(*) AS cells FROM part GROUP BY ALL)
SELECT p_type, round(stddev_pop(area) / avg(area), 8) AS area_spread, round(stddev_pop(extent) / avg(extent), 8) AS extent_spread, max(extent) AS top, round(sum(burned) / greatest(sum(cells), 1), 6) AS fraction FROM h GROUP BY p_type
""",
    "q_policy_means": """
WITH o AS (SELECT o_orderstatus, o_custkey, avg(o_totalprice) AS loss, count(*) AS steps FROM orders GROUP BY ALL), m AS (SELECT o_orderstatus, count(*) AS n, avg(loss) AS loss, avg(steps) AS steps FROM o GROUP BY o_orderstatus)
SELECT o_orderstatus, n, round(loss, 3) AS loss, round(steps, 6) AS steps, round(1 - loss / (SELECT loss FROM m WHERE o_orderstatus = 'O'), 8) AS skill FROM m
""",
    "q_area_ratio": """
WITH n AS (SELECT n_regionkey, n_nationkey, n_nationkey % 7 + 3.3::DOUBLE AS w, n_nationkey % 4 + 2.6::DOUBLE AS h FROM nation),
c AS (SELECT n_regionkey, n_nationkey, any_value(w * h * 3 / 4) AS exact, count(*) FILTER (x + 0.5 < w AND y + 0.5 < h / 2 + h / 2 * (x + 0.5) / w) AS cells FROM n, range(11) a(x), range(7) b(y) GROUP BY ALL)
SELECT n_regionkey, round(median(cells / exact), 7) AS median, round(max(abs(cells / exact - 1)), 7) AS worst FROM c GROUP BY n_regionkey
""",
    "q_schedule": """
WITH x AS (SELECT user_id, event_id, epoch_us(ts) // 60000000 AS t0, CAST(ceil((epoch_us(ts) // 60000000 + CAST(props->>'k' AS INT)) / 720.0::DOUBLE) AS BIGINT) * 720 AS tick FROM events WHERE event_type = 'click'),
g AS (SELECT user_id, tick, count(*) AS n, arg_max(event_id, (t0, event_id)) AS last FROM x GROUP BY user_id, tick)
SELECT user_id, tick, n, last, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY tick) AS BIGINT) AS n_so_far FROM g
""",
}
