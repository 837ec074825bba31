"""Fleet and task operators: suppliers are resources, parts are tasks on a grid 40 cells wide, events are tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinderframe.operators import fleet as fl, selection
from cinderframe.plans.raster_queries import CELL, K, _grid

KINDS = ("water", "retardant", "sensor", "crew")
TASKS = ("hold", "service", "observe", "water", "aerial_line", "line", "retardant")


def _of(column: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(column, F.lit(len(names))) + 1).cast("int"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Resources that have a line item of a part, with the part as a task; positions, kinds and states follow from the keys."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("t")).distinct()
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("t"), F.col("p_size").alias("size"))
    x = li.join(p, "t")
    return x.select(
        "r", "t", "size", _of(F.col("r"), KINDS).alias("kind"), _of(F.col("t"), TASKS).alias("task"), F.when(F.col("r") % 5 == 0, "reloading").otherwise("available").alias("status"),
        (F.col("r") * 7 % 40).alias("rx"), (F.col("r") * 13 % 25).alias("ry"), (F.col("t") % 40).alias("tx"), F.floor(F.col("t") / 40).alias("ty"), (20.0 + F.col("r") % 9).alias("speed"), (F.col("size") / 50.0).alias("value"),
    )


def _travelled(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumn("travel", fl.travel_minutes(F.col("tx") - F.col("rx"), F.col("ty") - F.col("ry"), CELL, F.col("speed")))


def q_compatible(spark: SparkSession, d: str) -> DataFrame:
    x = _pairs(spark, d).withColumn("ok", fl.compatible(F.col("task"), F.col("kind"), F.col("status")))
    return x.groupBy("task", "kind", "status").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


def q_feasible(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "kind": fl.compatible(F.col("task"), F.col("kind"), F.col("status")),
        "near": F.col("travel") <= 0.5,
        "wind": (F.col("size") <= 40) | ~F.col("kind").isin("water", "retardant"),
        "intensity": (F.col("value") <= 0.7) | (F.col("kind") != "crew"),
    }
    out = fl.feasible(_travelled(spark, d), rules)
    return out.select("r", "t", "feasible", F.array_join("broken", ",").alias("broken"))


def q_reserve(spark: SparkSession, d: str) -> DataFrame:
    sites = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("site_id"), (F.col("r_regionkey") * 9).alias("sx"), (F.col("r_regionkey") * 4).alias("sy"))
    x = _travelled(spark, d).withColumns({"used": (F.col("r") % 4).cast("double"), "endurance": F.lit(3.5)})
    out = fl.with_reserve(x, sites, CELL, ["r"], "tx", "ty", "speed", "used", "travel", "endurance", 0.2)
    return out.select("r", "t", F.round("recovery", 6).alias("recovery"), "reserve_ok")


def q_utility(spark: SparkSession, d: str) -> DataFrame:
    x = _travelled(spark, d)
    return x.select("r", "t", F.round(fl.utility(F.col("task"), F.col("kind"), F.col("value"), F.col("size") % 10 / 10.0, F.col("travel")), 8).alias("utility"))


def q_anchor_flank(spark: SparkSession, d: str) -> DataFrame:
    out = fl.anchor_flank(_travelled(spark, d), ["r"], "t", F.col("task"), F.round(F.col("value"), 6), F.col("t") % 2, F.round("travel", 6))
    return out.select("r", "t", F.round("score", 6).alias("score"))


def q_front_cells(spark: SparkSession, d: str) -> DataFrame:
    return fl.front_cells(_grid(spark, d).select("p_type", "y", "x", "p_size"), ["p_type"], "p_size", 4)


def q_shuffled_order(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").cast("string").alias("minute"), F.col("s_suppkey").cast("string").alias("r"))
    return fl.shuffled_order(s, ["minute"], "r", "7")


def q_heading(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'view'").select("user_id", "event_id", (F.col("value") % 40).alias("x"), (F.col("value") / 12).alias("y"))
    return fl.heading_deg(e, ["user_id"], "event_id", "x", "y").select("event_id", F.round("heading", 6).alias("heading"))


def q_trail(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("minute", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000))
    return fl.trail(e, ["user_id"], "minute", "value", 600).select("event_id", "n_trail", F.round("mean_trail", 6).alias("mean_trail"))


def q_coverage_level(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", F.round(fl.coverage_level(F.col("p_partkey") % 105 + 100, F.col("p_retailprice") * 3), 8).alias("level"))


DROPS = dict(nominal_payload=3000.0, axis=[1.0, 2.0, 4.0, 8.0], line_m=[400.0, 260.0, 130.0, 50.0], flow=[150.0, 300.0, 600.0, 1200.0], settings=["a", "b", "c", "d"], litres_m2=0.4)


def q_delivery(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    out = fl.delivery(F.col("p_size") / 5.0, F.col("p_retailprice") + 1, **DROPS)
    return p.select("p_partkey", *[(F.round(c, 6) if name in ("coverage", "line_m", "width_m", "flow") else c).alias(name) for name, c in out.items()])


def _legs(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    return s.select(k.alias("leg_id"), (k % 7).alias("owner"), (k * 7 % 40).cast("double").alias("ax"), (k * 13 % 50).cast("double").alias("ay"), (k * 11 % 40).cast("double").alias("bx"), (k * 3 % 50).cast("double").alias("by"), (k % 10).cast("double").alias("t0"), (k % 10 + 3).cast("double").alias("t1"), (k * 10.0 % 300).alias("altitude"))


def q_legs_in_volumes(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    x, y = (k * 5 % 35).cast("double"), (k * 9 % 45).cast("double")
    point = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    v = n.select(k.alias("volume_id"), F.array(point(0, 0), point(6, 1), point(5, 7), point(2, 3)).alias("polygon"), (k % 8).cast("double").alias("start"), (k % 8 + 4).cast("double").alias("end"), (k * 4.0).alias("low"), (k * 4.0 + 150).alias("high"), F.array(k % 7).alias("allowed"))
    return fl.legs_in_volumes(_legs(spark, d), v, 10.0)


def q_along_leg(spark: SparkSession, d: str) -> DataFrame:
    return fl.along_leg(_legs(spark, d).select("leg_id", "ax", "ay", "bx", "by"), _grid(spark, d).select(*K, "y", "x", "p_size").withColumnRenamed("incident", "g"), [], "p_size").select("leg_id", "sample", "y", "x", "p_size")


def q_centroid(spark: SparkSession, d: str) -> DataFrame:
    out = fl.centroid(_grid(spark, d).withColumn("w", F.when(F.col("p_type") == "PROMO", 0).otherwise(F.col("p_size"))), ["p_type"], "w")
    return out.select("p_type", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), "weight")


def q_weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).withColumns({"burned": F.col("p_size") > 30, "active": F.col("p_size").between(25, 30), "asset": F.col("x") / 40.0})
    out = fl.weighted_loss(g, ["p_type"], "burned", "active", "asset")
    return out.select("p_type", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def q_pooled(spark: SparkSession, d: str) -> DataFrame:
    out = fl.pooled(_grid(spark, d), K, "p_size", 5)
    return out.select("y", "x", F.round("mean", 6).alias("mean"), "top")


def q_projected(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").withColumn("over", F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("speed"), F.lit("99.5"))))
    n = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey <> 4").select(F.col("n_nationkey").alias("s_nationkey"), F.create_map(F.lit("speed"), F.concat(F.col("n_regionkey").cast("string"), F.lit(".5")), F.lit("bays"), F.col("n_nationkey").cast("string")).alias("profile"))
    return fl.projected(s.select("s_suppkey", "s_nationkey", "over"), n, "s_nationkey", {"speed": "double", "bays": "int"}, "over")


def q_greedy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The picks of greedy matching, in decisions of two resources and their tasks."""
    x = _travelled(spark, d).withColumn("case", F.floor(F.col("r") / 2)).withColumn("v", F.round(F.col("value") - F.col("travel"), 6))
    return selection.greedy_matching(x, ["case"], "r", "t", "v").select("case", "r", "t", "v")


QUERIES = {f.__name__: f for f in (q_compatible, q_feasible, q_reserve, q_utility, q_anchor_flank, q_front_cells, q_shuffled_order, q_heading, q_trail, q_coverage_level, q_delivery, q_legs_in_volumes, q_along_leg, q_centroid, q_weighted_loss, q_pooled, q_projected, q_greedy_pairs)}

_PAIRS = """
x AS (
  SELECT DISTINCT l_suppkey AS r, l_partkey AS t, p_size AS size, ['water', 'retardant', 'sensor', 'crew'][(l_suppkey % 4 + 1)::INT] AS kind,
         ['hold', 'service', 'observe', 'water', 'aerial_line', 'line', 'retardant'][(l_partkey % 7 + 1)::INT] AS task, CASE WHEN l_suppkey % 5 = 0 THEN 'reloading' ELSE 'available' END AS status,
         l_partkey % 40 AS tx, l_partkey // 40 AS ty, 20.0::DOUBLE + l_suppkey % 9 AS speed, p_size / 50.0::DOUBLE AS value,
         sqrt((l_partkey % 40 - l_suppkey * 7 % 40) ** 2 + (l_partkey // 40 - l_suppkey * 13 % 25) ** 2) * 30 / greatest((20.0::DOUBLE + l_suppkey % 9) * 60, 1) AS travel
  FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (
  SELECT *, task = 'hold' OR (status = 'available' AND CASE task WHEN 'service' THEN kind <> 'crew' WHEN 'observe' THEN kind = 'sensor' WHEN 'water' THEN kind = 'water'
    WHEN 'aerial_line' THEN kind IN ('water', 'retardant') WHEN 'line' THEN kind = 'crew' ELSE kind = 'retardant' END) AS ok FROM x)
"""
_LEGS = "l AS (SELECT s_suppkey AS k, (s_suppkey * 7 % 40)::DOUBLE AS ax, (s_suppkey * 13 % 50)::DOUBLE AS ay, (s_suppkey * 11 % 40)::DOUBLE AS bx, (s_suppkey * 3 % 50)::DOUBLE AS b2 FROM supplier)"
_TABLE = "CASE WHEN c <= 2 THEN {0} + (c - 1) * ({1} - {0}) WHEN c <= 4 THEN {1} + (c - 2) / 2 * ({2} - {1}) ELSE {2} + (c - 4) / 4 * ({3} - {2}) END"
SQL = {
    "q_compatible": f"WITH {_PAIRS} SELECT task, kind, status, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM c GROUP BY ALL",
    "q_feasible": f"""
WITH {_PAIRS}, b AS (SELECT r, t, array_to_string(list_filter([CASE WHEN NOT ok THEN 'kind' END, CASE WHEN travel > 0.5 THEN 'near' END, CASE WHEN size > 40 AND kind IN ('water', 'retardant') THEN 'wind' END,
  CASE WHEN value > 0.7 AND kind = 'crew' THEN 'intensity' END], lambda z: z IS NOT NULL), ',') AS broken FROM c)
SELECT r, t, coalesce(broken, '') = '' AS feasible, coalesce(broken, '') AS broken FROM b
""",
    "q_reserve": f"""
WITH {_PAIRS}, s AS (SELECT r_regionkey * 9 AS sx, r_regionkey * 4 AS sy FROM region),
m AS (SELECT r, t, any_value(travel) AS travel, min(sqrt((tx - sx) ** 2 + (ty - sy) ** 2) * 30 / greatest(speed * 60, 1)) AS recovery FROM x, s GROUP BY r, t)
SELECT r, t, round(recovery, 6) AS recovery, r % 4 + travel + recovery <= 3.5 - 0.2 AS reserve_ok FROM m
""",
    "q_utility": f"""
WITH {_PAIRS}
SELECT r, t, round(CASE WHEN task = 'hold' THEN 0 ELSE value * (1 - 0.35 * (size % 10 / 10.0::DOUBLE)) + CASE WHEN (task = 'water' AND kind = 'water') OR (task = 'line' AND kind = 'crew') THEN 0.9 ELSE 0 END
  + CASE WHEN task = 'observe' THEN 0.7 * (size % 10 / 10.0::DOUBLE) ELSE 0 END - 0.07 * travel END, 8) AS utility FROM x
""",
    "q_anchor_flank": f"""
WITH {_PAIRS}, s AS (SELECT r, t, round(value, 6) + CASE WHEN task IN ('retardant', 'reinforce', 'line') THEN 2.2::DOUBLE ELSE 0 END + (1 - t % 2) * 0.8::DOUBLE - 0.08::DOUBLE * round(travel, 6) AS score FROM x)
SELECT r, t, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY s.score DESC, t) = 1
""",
    "q_front_cells": "SELECT p_type, p_partkey // 40 AS y, p_partkey % 40 AS x, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey % 40 DESC, p_partkey // 40 DESC) AS slot FROM part QUALIFY slot <= 4",
    "q_shuffled_order": "SELECT s_nationkey::VARCHAR AS minute, s_suppkey::VARCHAR AS r, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('7:' || s_nationkey || ':' || s_suppkey), s_suppkey::VARCHAR) AS turn FROM supplier",
    "q_heading": """
WITH e AS (SELECT event_id, user_id, value % 40 AS x, value / 12 AS y FROM events WHERE event_type = 'view'),
b AS (SELECT *, coalesce(lag(x, 2) OVER w, first_value(x) OVER w) AS px, coalesce(lag(y, 2) OVER w, first_value(y) OVER w) AS py FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, round(degrees(atan2(y - py, x - px)), 6) AS heading FROM b
""",
    "q_trail": """
WITH e AS (SELECT event_id, user_id, value, epoch_us(ts) // 60000000 AS m FROM events)
SELECT event_id, count(*) OVER w AS n_trail, round(avg(value) OVER w, 6) AS mean_trail FROM e WINDOW w AS (PARTITION BY user_id ORDER BY m RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)
""",
    "q_coverage_level": """
WITH p AS (SELECT p_partkey, p_partkey % 105 + 100 AS f, p_retailprice * 3 AS i FROM part)
SELECT p_partkey, round(least(8, greatest(1, CASE WHEN f BETWEEN 101 AND 107 OR f IN (121, 122) THEN 1 WHEN f IN (123, 124) OR f BETWEEN 141 AND 147 THEN 3 WHEN f BETWEEN 161 AND 165 OR f BETWEEN 181 AND 185 THEN 4
  WHEN f BETWEEN 186 AND 189 OR f BETWEEN 201 AND 204 THEN 6 ELSE 2 END + greatest(i - 1000, 0) / 1800)), 8) AS level FROM p
""",
    "q_delivery": f"""
WITH p AS (SELECT p_partkey, p_size / 5.0::DOUBLE AS q, least(8, greatest(1, p_size / 5.0::DOUBLE)) AS c, p_retailprice + 1 AS v FROM part),
l AS (SELECT *, {_TABLE.format(400.0, 260.0, 130.0, 50.0)} * (v / 3000) AS line, {_TABLE.format(150.0, 300.0, 600.0, 1200.0)} AS flow FROM p)
SELECT p_partkey, round(c, 6) AS coverage, round(line, 6) AS line_m, round(v / (c * 0.4::DOUBLE) / greatest(line, 1e-9), 6) AS width_m, round(flow, 6) AS flow,
       CASE WHEN abs(c - 1) <= abs(c - 2) THEN 'a' WHEN abs(c - 2) <= abs(c - 4) THEN 'b' WHEN abs(c - 4) <= abs(c - 8) THEN 'c' ELSE 'd' END AS setting, NOT q BETWEEN 1 AND 8 AS extrapolated FROM l
""",
    "q_legs_in_volumes": f"""
WITH {_LEGS}, v AS (SELECT n_nationkey AS v, (n_nationkey * 5 % 35)::DOUBLE AS x, (n_nationkey * 9 % 45)::DOUBLE AS y FROM nation),
e AS (SELECT v, x + a AS cx, y + b AS cy, x + c AS dx, y + d AS dy FROM v, (VALUES (2, 3, 0, 0), (0, 0, 6, 1), (6, 1, 5, 7), (5, 7, 2, 3)) q(a, b, c, d)),
p AS (SELECT * FROM l JOIN e ON k % 10 < v % 8 + 4 AND k % 10 + 3 >= v % 8 AND k * 10 % 300 BETWEEN v * 4 AND v * 4 + 150 AND k % 7 <> v % 7),
o AS (
  SELECT *, (bx - ax) * (cy - ay) - (b2 - ay) * (cx - ax) AS o1, (bx - ax) * (dy - ay) - (b2 - ay) * (dx - ax) AS o2, (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx) AS o3, (dx - cx) * (b2 - cy) - (dy - cy) * (bx - cx) AS o4,
         (cy > ay) <> (dy > ay) AND ax < (dx - cx) * (ay - cy) / nullif(dy - cy, 0) + cx AS ra, (cy > b2) <> (dy > b2) AND bx < (dx - cx) * (b2 - cy) / nullif(dy - cy, 0) + cx AS rb FROM p),
m AS (
  SELECT k, v, bool_or((o1 * o2 < 0 AND o3 * o4 < 0) OR (o1 = 0 AND cx BETWEEN least(ax, bx) AND greatest(ax, bx) AND cy BETWEEN least(ay, b2) AND greatest(ay, b2))
      OR (o2 = 0 AND dx BETWEEN least(ax, bx) AND greatest(ax, bx) AND dy BETWEEN least(ay, b2) AND greatest(ay, b2)) OR (o3 = 0 AND ax BETWEEN least(cx, dx) AND greatest(cx, dx) AND ay BETWEEN least(cy, dy) AND greatest(cy, dy))
      OR (o4 = 0 AND bx BETWEEN least(cx, dx) AND greatest(cx, dx) AND b2 BETWEEN least(cy, dy) AND greatest(cy, dy))) AS crosses, count(*) FILTER (ra) AS na, count(*) FILTER (rb) AS nb FROM o GROUP BY k, v)
SELECT k AS leg_id, v AS volume_id FROM m WHERE crosses OR na % 2 = 1 OR nb % 2 = 1
""",
    "q_along_leg": f"""
WITH {_LEGS}, g AS (SELECT p_partkey // 40 AS y, p_partkey % 40 AS x, p_size FROM part), z AS (SELECT max(y) AS my, max(x) AS mx FROM g),
n AS (SELECT *, greatest(1, ceil(sqrt((bx - ax) ** 2 + (b2 - ay) ** 2)))::INT AS n FROM l),
s AS (SELECT k, unnest(range(0, n + 1)) AS i, n, ax, ay, bx, b2 FROM n),
c AS (SELECT k, i, greatest(0, least(my, round_even(ay + (b2 - ay) * i / n, 0)::INT)) AS y, greatest(0, least(mx, round_even(ax + (bx - ax) * i / n, 0)::INT)) AS x FROM s, z)
SELECT k AS leg_id, i AS sample, c.y, c.x, p_size FROM c JOIN g ON g.y = c.y AND g.x = c.x
""",
    "q_centroid": """
WITH g AS (SELECT p_type, p_partkey // 40 AS y, p_partkey % 40 AS x, CASE WHEN p_type = 'PROMO' THEN 0 ELSE p_size END AS w FROM part)
SELECT p_type, round(CASE WHEN sum(w) > 0 THEN sum(y * w) / sum(w) ELSE avg(y) END, 6) AS y, round(CASE WHEN sum(w) > 0 THEN sum(x * w) / sum(w) ELSE avg(x) END, 6) AS x, sum(w)::BIGINT AS weight FROM g GROUP BY p_type
""",
    "q_weighted_loss": """
WITH g AS (SELECT p_type, p_size > 30 AS b, p_size BETWEEN 25 AND 30 AS a, 1 + 9 * (p_partkey % 40 / 40.0::DOUBLE) AS w FROM part)
SELECT p_type, round(sum((b::INT + a::INT) * w), 6) AS loss, round(avg(b::INT), 6) AS burned_share, round(avg(a::INT), 6) AS active_share FROM g GROUP BY p_type
""",
    "q_pooled": "SELECT p_partkey // 40 // 5 AS y, p_partkey % 40 // 5 AS x, round(avg(p_size), 6) AS mean, max(p_size) AS top FROM part GROUP BY ALL",
    "q_projected": """
SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 99.5::DOUBLE WHEN n_nationkey <> 4 THEN n_regionkey + 0.5::DOUBLE END AS speed, CASE WHEN n_nationkey <> 4 THEN n_nationkey END AS bays FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
""",
    "q_greedy_pairs": f"""
WITH RECURSIVE {_PAIRS}, p AS (SELECT r // 2 AS k, r, t, round(value - travel, 6) AS v FROM x),
a AS (SELECT k, r, t, v, row_number() OVER (PARTITION BY r ORDER BY v DESC, t) AS n, dense_rank() OVER (PARTITION BY k ORDER BY r) AS turn FROM p),
f AS (SELECT k, r, t, v FROM a WHERE turn = 1 AND n = 1),
s AS (SELECT a.k, a.r, a.t, a.v FROM a LEFT JOIN f ON f.k = a.k WHERE a.turn = 2 AND a.t <> f.t QUALIFY row_number() OVER (PARTITION BY a.r ORDER BY a.v DESC, a.t) = 1)
SELECT k AS case, r, t, v FROM f UNION ALL SELECT k, r, t, v FROM s
""",
}
