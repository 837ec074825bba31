"""Small operators one by one: winds, decay, affine functions, scores, closures, fronts, and files written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.functions import geo, weather as wx
from cinderframe.operators import audit, frames as fr, fuel, scoring, statistics as st, timeseries as ts
from cinderframe.plans.fuel_queries import _W, _weather
from cinderframe.plans.stream_queries import _stream, scratch_folder
from cinderframe.plans.study_queries import _FORECAST, _forecasts
from cinderframe.sources import tables
from cinderframe.streaming import observations as ob

AFFINE = (30.0, 2.0, 5000.0, -1.0, -28.0, 9000.0)


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumns({"minute": F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000, "k": F.get_json_object("props", "$.k").cast("double")})


def q_score_variance(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.proper_scores(_forecasts(spark, d), ["lang"], "p", "quality")
    return out.select("lang", F.round("variance", 8).alias("variance"), F.round("brier", 6).alias("brier"))


def q_aggregate_skill(spark: SparkSession, d: str) -> DataFrame:
    """Skill of the means, also where the reference's mean is zero or less."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("ref", (F.col("l_linenumber") - 3).cast("double") * F.col("l_tax"))
    return st.aggregate_skill(li, ["l_linenumber"], "l_discount", "ref").select("l_linenumber", F.round("skill", 6).alias("skill"))


def q_interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").withColumns({"a": F.col("o_custkey") % 97 * 2000.0, "b": F.col("o_custkey") % 97 * 2000.0 + 120000})
    return st.interval_coverage(o, ["o_orderpriority"], "a", "b", "o_totalprice").select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("covered", "width", "below", "above")])


def q_asof_wind(spark: SparkSession, d: str) -> DataFrame:
    """Speed and direction at purchases between the clicks before and after them, by components."""
    e = _events(spark, d)
    samples = e.filter("event_type = 'view'").select("user_id", "minute", (2 + F.col("value") % 9).alias("speed"), (F.col("event_id") * 37 % 360).cast("double").alias("direction"))
    out = ts.asof_wind(samples, e.filter("event_type = 'purchase'").select("event_id", "user_id", "minute"), ["user_id"], "minute", "speed", "direction")
    return out.select("event_id", F.round("speed", 6).alias("speed"), F.round(F.sin(F.radians("direction")), 6).alias("east"))


def q_hourly_moisture(spark: SparkSession, d: str) -> DataFrame:
    """What each sample's local day holds, back at the sample."""
    x = _weather(spark, d)
    days = fuel.local_days(x, ["user_id"], "ts", "celsius", "humidity", "rain", -120.5).withColumnsRenamed({"t_min": "herbaceous", "rain": "woody"})
    return fuel.hourly_moisture(x.drop("rain"), days, ["user_id"], "ts", -120.5).select("user_id", "minute", F.round("herbaceous", 6).alias("herbaceous"), F.round("woody", 6).alias("woody"))


def q_wind_components(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", (F.col("value") % 20 + 0.5).alias("speed"), (F.col("event_id") * 37 % 360 + 0.25).alias("direction"))
    u, v = wx.wind_components(F.col("speed"), F.col("direction"))
    s, a = wx.wind_from(u, v)
    return e.select("event_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), F.round(s, 6).alias("speed"), F.round(a, 6).alias("direction"))


def q_affine(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"))
    cx, cy = geo.cell_centre(F.col("x"), F.col("y"), AFFINE)
    bx, by = geo.cell_of(cx, cy, AFFINE)
    return p.select("p_partkey", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), bx.alias("x"), by.alias("y"))


def q_decay_and_hazard(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    left = wx.half_life(F.col("value"), F.col("k"), F.lit(30.0))
    hazard = wx.ignition_hazard(F.col("value") / 100, F.col("k") / 50, F.lit(0.8), F.lit(3.0), F.lit(30.0))
    return e.select("event_id", F.round(left, 8).alias("remaining"), F.round(hazard, 8).alias("hazard"))


def q_weighted_closure(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") / 1e5).alias("score"), F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 4).cast("double")).alias("w"))
    out = audit.weighted_closure(o, ["o_custkey"], "o_orderstatus", "score", "w", ["F", "O", "P"])
    return out.select("o_custkey", "n", F.round("score", 6).alias("score"), "closed", "n_F", "n_O", "n_P")


def q_forbidden_tuning(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("split"), F.when(F.col("o_custkey") % 3 == 0, "tuning").otherwise("report").alias("use"))
    return audit.forbidden_tuning(o, "split", "use", ["1-URGENT", "2-HIGH"])


def q_fuel_sources(spark: SparkSession, d: str) -> DataFrame:
    """Which of the sources that orders name are of fuels, and how they stand to the order's year."""
    names = F.array(F.lit("LANDFIRE 1994"), F.lit("Fuel model"), F.lit("NAIP 1996"), F.lit("Vegetation map 1999"), F.lit(None).cast("string"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("name"), F.year(F.to_date("o_orderdate")).alias("year"))
    return o.groupBy(audit.names_fuel(F.col("name")).alias("fuel"), audit.provenance(F.col("name"), F.col("year")).alias("status")).agg(F.count("*").alias("n"))


def q_radial_errors(spark: SparkSession, d: str) -> DataFrame:
    """Parts as cells about an origin, a front for each brand: its radii against an expected one."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_brand", (F.floor(F.col("p_partkey") / 40) - 20).alias("y"), (F.col("p_partkey") % 40 - 20).alias("x"))
    out = fr.radial_errors(p.filter("y * y + x * x <= 300"), ["p_brand"], 30.0, F.length("p_brand") * 40.0)
    return out.select("p_brand", *[F.round(c, 6).alias(c) for c in ("equivalent_radius", "greatest_radius", "equivalent_error", "greatest_error")])


def q_case_atlas(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    out = fr.case_atlas(li, "l_returnflag", "l_linenumber", 0.9, ["l_quantity", "l_discount"])
    return out.select("l_returnflag", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("area", "mean_l_quantity", "most_l_quantity", "mean_l_discount", "most_l_discount", "growth")])


def q_fractions(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    shares = fr.fractions(p, ["p_brand"], {"burned": F.col("p_size") > 25, "active": F.col("p_size").between(20, 25)})
    areas = p.groupBy("p_brand", (F.col("p_partkey") % 8).alias("heading")).agg(F.sum("p_size").alias("area"), F.max("p_retailprice").alias("extent"))
    out = shares.join(fr.rotation_spread(areas, ["p_brand"], ["area", "extent"]), "p_brand")
    return out.select("p_brand", *[F.round(c, 6).alias(c) for c in ("burned", "active", "area_spread", "extent_spread")])


def q_area_means(spark: SparkSession, d: str) -> DataFrame:
    out = fr.area_means(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_suppkey"], "l_extendedprice")
    return out.select("l_suppkey", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90", "mean", "least", "most")])


def q_sites(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as service sites in a collection per nation; those verified by hand, as cells of a grid."""
    path = scratch_folder(spark, "sites")
    s, k = spark.read.parquet(f"{d}/supplier.parquet"), F.col("s_suppkey")
    where = F.struct(F.lit("Point").alias("type"), F.array((5000 + k * 61 % 900).cast("double"), (9000 - k * 37 % 900).cast("double")).alias("coordinates"))
    own = F.struct(k.cast("string").alias("site_id"), F.array(F.lit("water"), F.lit("fuel")).alias("services"), F.when(k % 3 > 0, "manually_verified").otherwise("candidate").alias("verification"))
    feature = F.struct(F.lit("Feature").alias("type"), own.alias("properties"), where.alias("geometry"))
    crs = F.struct(F.struct(F.lit("EPSG:32610").alias("name")).alias("properties"))
    docs = s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.first(crs).alias("crs"), F.collect_list(feature).alias("features"))).alias("value"))
    docs.write.partitionBy("s_nationkey").text(path)
    out = tables.read_sites(spark, f"{path}/*", "EPSG:32610", AFFINE)
    return out.select(F.col("site_id").cast("long").alias("s_suppkey"), "x", "y", F.size("services").alias("n_services"))


def q_replay(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "replay")
    tables.write_replay(_events(spark, d).select(F.floor("minute").alias("minute"), "user_id", "value"), path)
    return tables.read_replay(spark, path).groupBy("schema_version").agg(F.count("*").alias("n"), F.countDistinct("minute").alias("frames"), F.round(F.sum("value"), 3).alias("total"))


def q_lines_and_csv(spark: SparkSession, d: str) -> DataFrame:
    """Metrics appended as JSON lines in two goes, and a table as CSV with its columns in order, both read back."""
    path = scratch_folder(spark, "lines")
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    for rest in (0, 1):
        tables.append_lines(o.filter(F.col("o_orderkey") % 2 == rest), f"{path}/json")
    o.select(*sorted(o.columns)).write.option("header", True).csv(f"{path}/csv")
    a = spark.read.schema("o_orderkey long, o_custkey long, o_totalprice double").json(f"{path}/json")
    b = spark.read.option("header", True).schema("o_custkey long, o_orderkey long, o_totalprice double").csv(f"{path}/csv")
    one = lambda x, name: x.groupBy((F.col("o_custkey") % 10).alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("form", F.lit(name))
    return one(a, "json").union(one(b, "csv"))


def q_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """Which documents name a key twice."""
    s, k = spark.read.parquet(f"{d}/supplier.parquet"), F.col("s_suppkey")
    doc = F.format_string('{"a": %d, "b": {"x": 1, "%s": 2}, "%s": 3}', k, F.when(k % 3 == 0, "x").otherwise("y"), F.when(k % 4 == 0, "a").otherwise("c"))
    return s.select("s_suppkey", tables.repeated_names(doc).alias("twice"))


def q_terminal_stream(spark: SparkSession, d: str) -> DataFrame:
    """Steps of every user as a stream, up to the first purchase."""
    folder = scratch_folder(spark, "terminal")
    steps = _stream(spark, d).select(F.col("user_id").cast("string").alias("episode_id"), F.col("event_id").cast("long").alias("minute"), (F.col("event_type") == "purchase").alias("terminal"))
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    ob.until_terminal(steps).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy(F.col("episode_id").cast("long").alias("user_id")).agg(F.count("*").alias("steps"), F.max("minute").alias("last"), F.bool_or("terminal").alias("ended"))


QUERIES = {
    f.__name__: f
    for f in (q_score_variance, q_aggregate_skill, q_interval_coverage, q_asof_wind, q_hourly_moisture, q_wind_components, q_affine, q_decay_and_hazard, q_weighted_closure, q_forbidden_tuning, q_fuel_sources, q_radial_errors, q_case_atlas, q_fractions, q_area_means, q_sites, q_replay, q_lines_and_csv, q_catalogs, q_terminal_stream)
}

_DAYS_OF_SAMPLES = """
s AS (SELECT *, coalesce(minute - lag(minute) OVER u, lead(minute) OVER u - minute, 60) / 60.0::DOUBLE AS hours, (make_timestamp((minute * 60000000 - 28920000000)::BIGINT))::DATE AS day FROM w WINDOW u AS (PARTITION BY user_id ORDER BY minute)),
d AS (SELECT user_id, day, min(c) AS t_min, sum(r * hours) AS rain FROM s GROUP BY user_id, day)"""
SQL = {
    "q_score_variance": _FORECAST + "SELECT lang, round(avg(p * (1 - p)), 8) AS variance, round(avg((p - y) * (p - y)), 6) AS brier FROM h GROUP BY lang",
    "q_aggregate_skill": """
WITH m AS (SELECT l_linenumber, avg(l_discount::DOUBLE) AS s, avg((l_linenumber - 3)::DOUBLE * l_tax) AS r FROM lineitem GROUP BY 1)
SELECT l_linenumber, round(1 - CASE WHEN r <> 0 THEN s / r WHEN s > 0 THEN 'Infinity'::DOUBLE WHEN s < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END, 6) AS skill FROM m
""",
    "q_interval_coverage": """
WITH x AS (SELECT o_orderpriority, o_totalprice::DOUBLE AS o, o_custkey % 97 * 2000.0::DOUBLE AS a, o_custkey % 97 * 2000.0::DOUBLE + 120000 AS b FROM orders)
SELECT o_orderpriority, count(*) AS n, round(avg((o BETWEEN a AND b)::INT), 6) AS covered, round(avg(b - a), 6) AS width, round(avg((o < a)::INT), 6) AS below, round(avg((o > b)::INT), 6) AS above FROM x GROUP BY 1
""",
    "q_asof_wind": """
WITH e AS (SELECT *, epoch_us(ts) / 60000000.0::DOUBLE AS t FROM events),
s AS (SELECT user_id, t, -(2 + value % 9) * sin(radians(event_id * 37 % 360)) AS u, -(2 + value % 9) * cos(radians(event_id * 37 % 360)) AS v FROM e WHERE event_type = 'view'),
q AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'),
b AS (SELECT q.event_id, q.t, x.t AS t0, x.u AS u0, x.v AS v0, y.t AS t1, y.u AS u1, y.v AS v1 FROM q ASOF LEFT JOIN s x ON q.user_id = x.user_id AND q.t >= x.t ASOF LEFT JOIN s y ON q.user_id = y.user_id AND q.t < y.t),
c AS (SELECT event_id, CASE WHEN t0 IS NULL THEN u1 WHEN t1 IS NULL THEN u0 ELSE u0 + (t - t0) / (t1 - t0) * (u1 - u0) END AS u, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END AS v FROM b)
SELECT event_id, round(sqrt(u * u + v * v), 6) AS speed, round(sin(atan2(-u, -v)), 6) AS east FROM c
""",
    "q_hourly_moisture": f"WITH {_W}, {_DAYS_OF_SAMPLES} SELECT s.user_id, minute, round(t_min, 6) AS herbaceous, round(d.rain, 6) AS woody FROM s JOIN d ON d.user_id = s.user_id AND d.day = s.day",
    "q_wind_components": """
WITH e AS (SELECT event_id, value % 20 + 0.5 AS s, event_id * 37 % 360 + 0.25::DOUBLE AS a FROM events)
SELECT event_id, round(-s * sin(radians(a)), 6) AS u, round(-s * cos(radians(a)), 6) AS v, round(s, 6) AS speed, round(a, 6) AS direction FROM e
""",
    "q_affine": "SELECT p_partkey, 30 * (p_partkey % 40 + 0.5::DOUBLE) + 2 * (p_partkey // 40 + 0.5::DOUBLE) + 5000 AS cx, -1 * (p_partkey % 40 + 0.5::DOUBLE) - 28 * (p_partkey // 40 + 0.5::DOUBLE) + 9000 AS cy, p_partkey % 40 AS x, p_partkey // 40 AS y FROM part",
    "q_decay_and_hazard": """
WITH e AS (SELECT event_id, value, CAST(props->>'k' AS DOUBLE) AS k FROM events)
SELECT event_id, round(value * pow(0.5::DOUBLE, k / 30), 8) AS remaining, round(least(1, greatest(0, 1 - exp(-greatest(0, value / 100 * k / 50 * 0.8::DOUBLE * 3 / 30)))), 8) AS hazard FROM e
""",
    "q_weighted_closure": """
WITH o AS (SELECT o_custkey, o_orderstatus AS t, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 1e5 END AS s, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 4)::DOUBLE ELSE 1 END AS w FROM orders)
SELECT o_custkey, count(*) AS n, round(CASE WHEN sum(w) <> 0 THEN sum(w * coalesce(s, 0)) / sum(w) END, 6) AS score, bool_and(s IS NOT NULL) AS closed, count(*) FILTER (t = 'F') AS "n_F", count(*) FILTER (t = 'O') AS "n_O", count(*) FILTER (t = 'P') AS "n_P" FROM o GROUP BY o_custkey
""",
    "q_forbidden_tuning": "SELECT o_orderpriority AS split, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1",
    "q_fuel_sources": """
WITH o AS (SELECT ['LANDFIRE 1994', 'Fuel model', 'NAIP 1996', 'Vegetation map 1999', NULL][o_orderkey % 5 + 1] AS name, year(o_orderdate::DATE) AS y FROM orders),
x AS (SELECT *, nullif(regexp_extract(name, '(19|20)[0-9]{2}'), '')::INT AS w FROM o)
SELECT coalesce(lower(name) LIKE '%landfire%' OR lower(name) LIKE '%fuel%' OR lower(name) LIKE '%vegetation%', false) AS fuel,
  CASE WHEN name IS NULL THEN 'unknown' WHEN w > y THEN 'after_incident' WHEN w = y THEN 'same_year' WHEN w IS NOT NULL THEN 'before_incident' ELSE 'undated' END AS status, count(*) AS n FROM x GROUP BY ALL
""",
    "q_radial_errors": """
WITH p AS (SELECT p_brand, p_partkey // 40 - 20 AS y, p_partkey % 40 - 20 AS x FROM part),
r AS (SELECT p_brand, sqrt(count(*) * 900 / pi()) AS e, max(sqrt(x * x + y * y) * 30) AS g FROM p WHERE y * y + x * x <= 300 GROUP BY 1)
SELECT p_brand, round(e, 6) AS equivalent_radius, round(g, 6) AS greatest_radius, round(abs(e - length(p_brand) * 40), 6) AS equivalent_error, round(abs(g - length(p_brand) * 40), 6) AS greatest_error FROM r
""",
    "q_case_atlas": """
WITH a AS (SELECT l_returnflag, l_linenumber, count(*) * 0.9::DOUBLE AS area, avg(l_quantity) AS mq, max(l_quantity) AS xq, avg(l_discount) AS md, max(l_discount) AS xd FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linenumber, round(area, 6) AS area, round(mq, 6) AS mean_l_quantity, round(xq, 6) AS most_l_quantity, round(md, 6) AS mean_l_discount, round(xd, 6) AS most_l_discount,
  round(area - coalesce(lag(area) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber), 0), 6) AS growth FROM a
""",
    "q_fractions": """
WITH h AS (SELECT p_brand, p_partkey % 8 AS heading, sum(p_size)::DOUBLE AS area, max(p_retailprice) AS extent FROM part GROUP BY ALL),
s AS (SELECT p_brand, stddev_pop(area) / avg(area) AS a, stddev_pop(extent) / avg(extent) AS e FROM h GROUP BY 1)
SELECT p.p_brand, round(avg((p_size > 25)::INT), 6) AS burned, round(avg((p_size BETWEEN 20 AND 25)::INT), 6) AS active, round(any_value(a), 6) AS area_spread, round(any_value(e), 6) AS extent_spread FROM part p JOIN s USING (p_brand) GROUP BY 1
""",
    "q_area_means": """
SELECT l_suppkey, round(quantile_cont(l_extendedprice::DOUBLE, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice::DOUBLE, 0.9), 4) AS p90, round(avg(l_extendedprice), 4) AS mean, round(min(l_extendedprice), 4) AS least, round(max(l_extendedprice), 4) AS most FROM lineitem GROUP BY 1
""",
    "q_sites": """
WITH s AS (SELECT s_suppkey, s_suppkey * 61 % 900 AS px, -(s_suppkey * 37 % 900) AS py FROM supplier WHERE s_suppkey % 3 > 0)
SELECT s_suppkey, round_even((-28 * px - 2 * py) / -838.0::DOUBLE, 0)::INT AS x, round_even((30 * py + px) / -838.0::DOUBLE, 0)::INT AS y, 2 AS n_services FROM s
""",
    "q_replay": "SELECT 1 AS schema_version, count(*) AS n, count(DISTINCT epoch_us(ts) // 60000000) AS frames, round(sum(value), 3) AS total FROM events",
    "q_lines_and_csv": "SELECT o_custkey % 10 AS grp, count(*) AS n, round(sum(o_totalprice), 2) AS total, form FROM orders, (VALUES ('json'), ('csv')) f(form) GROUP BY ALL",
    "q_catalogs": "SELECT s_suppkey, trim(CASE WHEN s_suppkey % 4 = 0 THEN 'a' ELSE '' END || CASE WHEN s_suppkey % 12 = 0 THEN ', ' ELSE '' END || CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE '' END) AS twice FROM supplier",
    "q_terminal_stream": """
WITH f AS (SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS stop FROM events GROUP BY 1)
SELECT e.user_id, count(*) AS steps, max(event_id) AS last, bool_or(event_type = 'purchase') AS ended FROM events e JOIN f USING (user_id) WHERE stop IS NULL OR event_id <= stop GROUP BY 1
""",
}
