"""Service at sites, rules for actions, registries of evidence, suitability of grids, radius rates, labels and stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.functions import geo
from cinderframe.operators import fleet, service as sv, timeseries as ts
from cinderframe.plans.stream_queries import scratch_folder
from cinderframe.sources import tables


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as visits of a supplier's site, on the day that they ship."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("minute", (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) * 1440).cast("long"))
    return li.withColumn("age", F.col("l_partkey") % 50)


def q_site_service(spark: SparkSession, d: str) -> DataFrame:
    """What every site gives to the visits that it admits: loads end where its stock does."""
    k = F.col("s_suppkey")
    sites = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("l_suppkey"), (1 + k % 2).cast("int").alias("bays"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("stock"), (k % 7 * 144_000).alias("open_minute"), (k % 7 * 144_000 + 3_600_000).alias("close_minute"), (5 + k % 3).alias("fixed_minutes"), (2.5 + k % 4).alias("rate"))
    index = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    out = sv.served(_arrivals(spark, d), sites, "l_suppkey", "minute", "age", index, "l_quantity", F.col("l_returnflag") != "R", chunk=1440.0 * 90)
    return out.groupBy("l_suppkey").agg(F.count("*").alias("visits"), F.round(F.sum("load"), 2).alias("load"), F.round(F.min("stock_left"), 2).alias("stock_left"), F.sum("minutes").alias("minutes"), F.count_if(F.col("load") > 0).alias("loaded"))


def q_running_before(spark: SparkSession, d: str) -> DataFrame:
    """Quantities shipped by each supplier on the days before every day."""
    days = _arrivals(spark, d).groupBy("l_suppkey", "minute").agg(F.sum("l_quantity").alias("q"))
    return sv.running_before(days, ["l_suppkey"], F.floor(F.col("minute") / (1440 * 90)), ["minute"], "q", "before").select("l_suppkey", "minute", "q", "before")


def q_action_rules(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as offers of tasks to resources: which rules each breaks."""
    name = lambda c, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    li, o, p, s = _arrivals(spark, d), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    task, kind = name(o, "hold", "service", "water", "line", "observe", "service"), name(p, "water", "retardant", "sensor", "crew")
    status = F.when(p % 11 == 0, "returning").otherwise("available")
    own = {"payload": F.col("l_discount") * 10, "flown": (p % 3).cast("double"), "latency": p % 20, "modes": F.array(name(p, "scoop", "dip"), F.lit("ramp")), "max_wind": 5.0 + p % 10, "max_intensity": 500.0 + p % 1000, "depth": (p % 4) / 2, "length": (p % 5) * 100.0}
    site = {"mode": name(s, "scoop", "dip", "ramp"), "services": F.when(s % 2 == 0, F.array(F.lit("water"), F.lit("fuel"))).otherwise(F.array(F.lit("retardant"))), "bays": s % 6, "open": s % 300, "close": s % 300 + 400, "max_wind": 4.0 + s % 12, "depth": (s % 5) / 2, "length": (s % 7) * 100.0, "stock": F.when(s % 9 > 0, 100.0).otherwise(0.0)}
    rules = sv.action_rules(task, kind, status, own, site, o % 500, F.col("l_quantity") * 1.5, F.col("l_tax") * 150, F.col("l_extendedprice") / 50, F.col("l_quantity") < 45, 0.2, 11.0, 1200.0)
    out = fleet.feasible(li, rules)
    return out.groupBy(task.alias("task"), F.array_join("broken", ", ").alias("broken")).agg(F.count("*").alias("n"), F.count_if("feasible").alias("feasible"))


def q_registry_faults(spark: SparkSession, d: str) -> DataFrame:
    """A registry a order: its lines' parts are documents, the lines are profiles that cite part and supplier."""
    path, li = scratch_folder(spark, "registries"), spark.read.parquet(f"{d}/lineitem.parquet")
    text = lambda c: F.col(c).cast("string")
    cites = F.array(text("l_partkey"), F.when(F.col("l_returnflag") == "R", text("l_suppkey")).otherwise(text("l_partkey")))
    domain = F.create_map(F.lit("range"), F.struct(F.col("l_linestatus").alias("status"), cites.alias("document_ids")))
    lines = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(text("l_partkey").alias("document_id"))).alias("documents"), F.collect_list(F.struct(text("l_linenumber").alias("profile_id"), domain.alias("domains"))).alias("profiles"))
    lines.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), text("l_orderkey").alias("registry_id"), "documents", "profiles"))).write.text(path)
    known = li.select(text("l_orderkey").alias("registry_id"), (F.col("l_linenumber") - 1).cast("string").alias("profile_id"))
    return sv.registry_faults(*tables.read_registries(spark, path, lines=True), known)


def q_metric_suitability(spark: SparkSession, d: str) -> DataFrame:
    """Grids of customers, some of them named in Web Mercator or degrees."""
    k = F.col("c_custkey")
    lat, lon = k % 140 - 70, k % 360 - 180
    code = F.when(k % 5 == 0, 3857).when(k % 5 == 1, 4326).when(k % 35 == 2, F.lit(None)).otherwise(geo.utm_epsg(lon, lat))
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("m", geo.metric_suitability(code, lat))
    return c.select("c_custkey", "m.web_mercator", "m.metric", F.round("m.scale", 9).alias("scale"), F.round("m.area_scale", 9).alias("area_scale"), "m.reason")


def q_radius_rate(spark: SparkSession, d: str) -> DataFrame:
    """How fast the radius of a circle of as many cells as a customer's order costs grew since the order before."""
    o = spark.read.parquet(f"{d}/orders.parquet").withColumns({"minute": F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 60_000_000, "cells": F.floor("o_totalprice")})
    x = ts.lagged(o, ["o_custkey"], "minute", ["o_orderkey"], ["minute", "cells"], chunk=1440.0 * 365)
    return x.select("o_orderkey", F.round(geo.radius_rate(F.col("_prev.cells"), F.col("cells"), F.col("minute") - F.col("_prev.minute"), 30.0), 8).alias("rate"))


def q_clock_label(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    origin = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", geo.clock_label(origin, F.col("o_custkey") % 1500).alias("label"))


def q_stretched(spark: SparkSession, d: str) -> DataFrame:
    """Prices as brightness, by priority."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return sv.stretched(o, ["o_orderpriority"], "o_totalprice", "bright", gamma=2.2).select("o_orderkey", F.round("bright", 8).alias("bright"))


QUERIES = {f.__name__: f for f in (q_site_service, q_running_before, q_action_rules, q_registry_faults, q_metric_suitability, q_radius_rate, q_clock_label, q_stretched)}

_MINUTE = "CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 1440 AS BIGINT)"
SQL = {
    "q_site_service": f"""
WITH s AS (SELECT s_suppkey AS k, 1 + s_suppkey % 2 AS bays, greatest(s_acctbal, 0.0) AS stock FROM supplier),
x AS (
  SELECT l.*, bays, stock, {_MINUTE} AS minute, l_partkey % 50 AS age, CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS want
  FROM lineitem l JOIN s ON s.k = l_suppkey WHERE {_MINUTE} >= k % 7 * 144000 AND {_MINUTE} < k % 7 * 144000 + 3600000),
a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, minute ORDER BY age DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS r FROM x QUALIFY r <= bays),
b AS (SELECT *, sum(want) OVER (PARTITION BY l_suppkey ORDER BY minute, r ROWS UNBOUNDED PRECEDING) AS used FROM a),
c AS (SELECT *, least(want, greatest(0.0, stock - (used - want))) AS load FROM b)
SELECT l_suppkey, count(*) AS visits, round(sum(load), 2) AS load, round(min(greatest(0.0, stock - used)), 2) AS stock_left,
       CAST(sum(greatest(1, ceil(5 + l_suppkey % 3 + load / (2.5 + l_suppkey % 4)))) AS BIGINT) AS minutes, count(*) FILTER (load > 0) AS loaded
FROM c GROUP BY l_suppkey
""",
    "q_running_before": f"""
WITH x AS (SELECT l_suppkey, {_MINUTE} AS minute, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_suppkey, minute, q, coalesce(sum(q) OVER (PARTITION BY l_suppkey ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x
""",
    "q_action_rules": """
WITH x AS (
  SELECT *, ['hold', 'service', 'water', 'line', 'observe', 'service'][l_orderkey % 6 + 1] AS task, ['water', 'retardant', 'sensor', 'crew'][l_partkey % 4 + 1] AS kind,
         [['scoop', 'dip'][l_partkey % 2 + 1], 'ramp'] AS modes, ['scoop', 'dip', 'ramp'][l_suppkey % 3 + 1] AS mode,
         CASE WHEN l_suppkey % 2 = 0 THEN ['water', 'fuel'] ELSE ['retardant'] END AS services, l_orderkey % 500 + ceil(l_quantity * 1.5) + l_partkey % 20 AS arrival,
         l_tax * 150 AS wind FROM lineitem),
y AS (
  SELECT task, CASE WHEN task = 'hold' THEN [] ELSE list_filter([
    CASE WHEN l_partkey % 11 = 0 OR NOT (CASE task WHEN 'service' THEN kind <> 'crew' WHEN 'water' THEN kind = 'water' WHEN 'line' THEN kind = 'crew' ELSE kind = 'sensor' END) THEN 'kind' END,
    CASE WHEN task = 'service' AND NOT list_contains(modes, mode) THEN 'mode' END,
    CASE WHEN task = 'service' AND NOT ((l_discount * 10 < 1 - 1e-6 AND list_contains(services, kind)) OR (l_partkey % 3 > 0 AND list_contains(services, 'fuel'))) THEN 'use' END,
    CASE WHEN task = 'service' AND l_suppkey % 6 = 0 THEN 'bays' END,
    CASE WHEN task = 'service' AND NOT (arrival >= l_suppkey % 300 AND arrival < l_suppkey % 300 + 400) THEN 'hours' END,
    CASE WHEN task = 'service' AND wind > 4 + l_suppkey % 12 THEN 'site_wind' END,
    CASE WHEN task = 'service' AND l_suppkey % 5 < l_partkey % 4 THEN 'depth' END,
    CASE WHEN task = 'service' AND l_suppkey % 7 < l_partkey % 5 THEN 'length' END,
    CASE WHEN task = 'service' AND list_contains(services, kind) AND l_suppkey % 9 = 0 THEN 'stock' END,
    CASE WHEN kind IN ('water', 'retardant') AND task <> 'service' AND l_discount * 10 < 0.2 THEN 'payload' END,
    CASE WHEN kind IN ('water', 'retardant') AND wind > least(5 + l_partkey % 10, 11) THEN 'wind' END,
    CASE WHEN kind = 'crew' AND l_extendedprice / 50 > least(500 + l_partkey % 1000, 1200) THEN 'intensity' END,
    CASE WHEN l_quantity >= 45 THEN 'reserve' END], lambda r: r IS NOT NULL) END AS broken FROM x)
SELECT task, array_to_string(broken, ', ') AS broken, count(*) AS n, count(*) FILTER (len(broken) = 0) AS feasible FROM y GROUP BY ALL
""",
    "q_registry_faults": """
WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) AS registry_id, CAST(l_partkey AS VARCHAR) AS part, CAST(l_suppkey AS VARCHAR) AS supp, CAST(l_linenumber AS VARCHAR) AS line, CAST(l_linenumber - 1 AS VARCHAR) AS known, l_returnflag AS flag FROM lineitem)
SELECT registry_id, 'document twice' AS fault, part AS name FROM l GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT registry_id, 'profile twice', line FROM l GROUP BY ALL HAVING count(*) > 1
UNION ALL (SELECT registry_id, 'unknown document', supp FROM l WHERE flag = 'R' EXCEPT SELECT registry_id, 'unknown document', part FROM l)
UNION ALL (SELECT registry_id, 'no evidence', known FROM l EXCEPT SELECT registry_id, 'no evidence', line FROM l)
UNION ALL (SELECT registry_id, 'unknown profile', line FROM l EXCEPT SELECT registry_id, 'unknown profile', known FROM l)
""",
    "q_metric_suitability": """
SELECT c_custkey, k = 0 AS web_mercator, k > 1 AND c_custkey % 35 <> 2 AS metric, CASE WHEN k = 0 THEN round(cos(radians(lat)), 9) END AS scale,
       CASE WHEN k = 0 THEN round(cos(radians(lat)) * cos(radians(lat)), 9) END AS area_scale,
       CASE WHEN k = 0 THEN 'scale varies with latitude' WHEN k = 1 OR c_custkey % 35 = 2 THEN 'no projected grid in metres' END AS reason
FROM (SELECT c_custkey, c_custkey % 5 AS k, c_custkey % 140 - 70 AS lat FROM customer)
""",
    "q_radius_rate": """
WITH x AS (
  SELECT o_orderkey, epoch(CAST(o_orderdate AS TIMESTAMP)) / 60 AS m, floor(o_totalprice) AS n, lag(m) OVER w AS pm, lag(n) OVER w AS pn
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CASE WHEN m > pm THEN round(greatest(0.0, 30 * sqrt(n / pi()) - 30 * sqrt(pn / pi())) / (m - pm), 8) END AS rate FROM x
""",
    "q_clock_label": """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN strftime(CAST(o_orderdate AS TIMESTAMP) + to_minutes(o_custkey % 1500), '%Y-%m-%dT%H:%M') || '+00:00'
                        ELSE 'T+' || printf('%03d', o_custkey % 1500) || ' min' END AS label FROM orders
""",
    "q_stretched": """
WITH q AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.02) AS a, quantile_cont(o_totalprice, 0.98) AS b FROM orders GROUP BY 1)
SELECT o_orderkey, round(pow(least(1.0, greatest(0.0, (o_totalprice - a) / CASE WHEN b > a THEN b - a ELSE 1 END)), 1 / 2.2), 8) AS bright
FROM orders JOIN q ON p IS NOT DISTINCT FROM o_orderpriority
""",
}
