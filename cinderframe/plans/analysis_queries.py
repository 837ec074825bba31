"""Forcing analysis from stations, and look-ups in performance surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.operators import analysis, surfaces
from cinderframe.plans.stream_queries import scratch_folder
from cinderframe.sources import tables


def q_forcing_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a grid of background weather at two times, corrected by the suppliers as stations."""
    p = spark.read.parquet(f"{d}/part.parquet").select((F.floor(F.col("p_partkey") / 40)).alias("y"), (F.col("p_partkey") % 40).alias("x"), "p_size", F.explode(F.array(F.lit(0), F.lit(60))).alias("minute"))
    size, minute = F.col("p_size"), F.col("minute")
    base = p.select("minute", "y", "x", (3 + size / 10 + minute / 60).alias("speed"), ((size * 7 + minute) % 360).cast("double").alias("direction"), (15.0 + size % 10).alias("celsius"), (50.0 + size).alias("humidity"), (0.05 + size / 1000).alias("dead"))
    s, k = spark.read.parquet(f"{d}/supplier.parquet"), F.col("s_suppkey")
    bal = F.abs(F.col("s_acctbal").cast("double"))
    stations = s.select(
        (F.col("s_nationkey") * 4).alias("minute"), (k / 2).alias("y"), (k * 7.3 % 40).alias("x"), (2 + bal % 7).alias("speed"),
        F.when(k % 5 > 0, (k * 37 % 360).cast("double")).alias("direction"), F.when(k % 4 > 0, 10 + bal % 20).alias("celsius"), (20 + bal % 90).alias("humidity"), F.when(k % 4 > 0, bal % 3).alias("dead"),
    )
    out = analysis.forcing_analysis(base.withColumn("incident", F.lit("g")), stations.withColumn("incident", F.lit("g")), ["incident"], ["celsius", "humidity", "dead"], 3.0, tile=12.0, reach=9.0, merge=0.75)
    return out.select("minute", "y", "x", "station_count", *[F.round(c, 6).alias(c) for c in ("speed", "direction", "u_correction", "v_correction", "wind_sd", "celsius", "celsius_sd", "humidity", "humidity_sd", "dead", "dead_sd")])


def _surface_documents(spark: SparkSession, d: str, path: str) -> None:
    """A surface of each brand: four altitudes, three payloads, tables that follow the brand's mean price."""
    b = spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("m"))
    number = lambda *x: F.array(*[v if hasattr(v, "cast") else F.lit(float(v)) for v in x])
    table = lambda f: F.array(*[F.array(*[f(i, j) for j in range(3)]) for i in range(4)])
    doc = F.struct(
        F.lit(1).alias("schema_version"), number(0, 800, 2000, 3500).alias("density_altitude_m"), number(0, 0.5, 1).alias("payload_fraction"),
        table(lambda i, j: F.col("m") / 20 - 3 * i - 2 * j * j).alias("true_airspeed_m_s"), table(lambda i, j: F.col("m") / 1000 - i / 20 - j / 50).alias("endurance_multiplier"),
        number(1, 0.9, 0.75, 0.5).alias("maximum_payload_fraction"), F.struct(F.col("p_brand").alias("source")).alias("metadata"),
    )
    b.select("p_brand", F.to_json(doc).alias("value")).write.partitionBy("p_brand").text(path)


def q_surface_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Speed, endurance and greatest payload of every order line's leg, from its brand's surface, with what lies outside the axes."""
    path = scratch_folder(spark, "surfaces")
    _surface_documents(spark, d, path)
    surface, payload = tables.read_surfaces(spark, f"{path}/*")
    brand = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand")
    legs = spark.read.parquet(f"{d}/lineitem.parquet").join(brand, F.col("l_partkey") == F.col("p_partkey"))
    legs = legs.select("l_orderkey", "l_linenumber", F.col("p_brand").alias("surface"), (F.col("l_extendedprice").cast("double") % 4500 - 400).alias("altitude"), (F.col("l_quantity").cast("double") / 45).alias("load"))
    out = surfaces.bilinear(legs, surface, ["surface"], "altitude", "load", ["true_airspeed_m_s", "endurance_multiplier"])
    out = surfaces.linear(out.withColumnsRenamed({"altitude_outside": "a_out", "load_outside": "l_out"}), payload, ["surface"], "altitude", ["maximum_payload_fraction"])
    return out.groupBy("surface", "a_out", "l_out").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 3).alias(c) for c in ("true_airspeed_m_s", "endurance_multiplier", "maximum_payload_fraction")])


QUERIES = {f.__name__: f for f in (q_forcing_analysis, q_surface_lookup)}

def solves_sql(length: float, noise: float, tile: int) -> str:
    """CTEs from p (t, ty, tx, f, stations as a list of y, x, d, n) and cells c (t, y, x) to o (t, y, x, f, c, s): the covariances'
    inverse by elimination, a station a step."""
    return _SOLVES.replace("{two}", str(2 * length * length)).replace("{noise}", str(noise)).replace("{tile}", str(tile))


_SOLVES = """e AS (
  SELECT t, ty, tx, f, p, 0 AS k, list_transform(range(1, len(p) + 1), lambda i: list_concat(
    list_transform(p, lambda q, j: exp(((p[i].y - q.y) * (p[i].y - q.y) + (p[i].x - q.x) * (p[i].x - q.x)) / -{two}::DOUBLE) + CASE WHEN i = j THEN {noise}::DOUBLE * {noise}::DOUBLE / q.n ELSE 0 END),
    list_transform(p, lambda q, j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS a FROM p
  UNION ALL
  SELECT t, ty, tx, f, p, k + 1, list_transform(a, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda z: z / a[k + 1][k + 1])
    ELSE list_transform(r, lambda z, j: z - r[k + 1] * a[k + 1][j] / a[k + 1][k + 1]) END) FROM e WHERE k < len(p)),
w AS (
  SELECT c.t, c.y, c.x, e.f, e.p, e.a, list_transform(e.p, lambda q: exp(((q.y - c.y) * (q.y - c.y) + (q.x - c.x) * (q.x - c.x)) / -{two}::DOUBLE)) AS r
  FROM c JOIN e ON e.t = c.t AND e.ty = c.y // {tile} AND e.tx = c.x // {tile} AND e.k = len(e.p)),
hv AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: list_sum(list_transform(r, lambda z, j: z * a[i][len(p) + j]))) AS h FROM w),
o AS (
  SELECT t, y, x, f, list_sum(list_transform(p, lambda q, i: q.d * h[i])) AS c, sqrt(greatest(0, least(1, 1 - list_sum(list_transform(r, lambda z, i: z * h[i]))))) AS s FROM hv)"""
_BRACKET = "least(greatest(len(list_filter({axis}, lambda q: q <= least(greatest({x}, {axis}[1]), {axis}[-1]))), 1), len({axis}) - 1)"
SQL = {
    "q_forcing_analysis": """
WITH RECURSIVE
c AS (
  SELECT t, p_partkey // 40 AS y, p_partkey % 40 AS x, 3 + p_size / 10.0::DOUBLE + t / 60 AS speed, (p_size * 7 + t) % 360 AS dir, 15.0::DOUBLE + p_size % 10 AS celsius, 50.0::DOUBLE + p_size AS humidity, 0.05::DOUBLE + p_size / 1000.0::DOUBLE AS dead
  FROM part, (VALUES (0), (60)) m(t)),
b AS (SELECT *, -speed * sin(radians(dir)) AS u, -speed * cos(radians(dir)) AS v FROM c),
s AS (
  SELECT t, s_suppkey / 2.0::DOUBLE AS y, s_suppkey * 7.3::DOUBLE % 40 AS x, 2 + bal % 7 AS speed, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 37 % 360 END AS dir,
    CASE WHEN s_suppkey % 4 > 0 THEN 10 + bal % 20 END AS celsius, 20 + bal % 90 AS humidity, CASE WHEN s_suppkey % 4 > 0 THEN bal % 3 END AS dead
  FROM (SELECT *, abs(s_acctbal::DOUBLE) AS bal FROM supplier), (VALUES (0), (60)) m(t) WHERE abs(s_nationkey * 4 - t) <= 40),
box AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM c),
i AS (
  SELECT s.t, s.y, s.x, -s.speed * sin(radians(s.dir)) - b.u AS u, -s.speed * cos(radians(s.dir)) - b.v AS v, s.celsius - b.celsius AS celsius, s.humidity - b.humidity AS humidity, s.dead - b.dead AS dead
  FROM s, box JOIN b ON b.t = s.t AND b.y = greatest(y0, least(y1, ceil(s.y - 0.5))) AND b.x = greatest(x0, least(x1, ceil(s.x - 0.5)))),
m AS (
  SELECT t, avg(y) AS y, avg(x) AS x, count(*) AS n, avg(u) AS u, avg(v) AS v, avg(celsius) AS celsius, avg(humidity) AS humidity, avg(dead) AS dead
  FROM i GROUP BY t, floor(y / 0.75::DOUBLE), floor(x / 0.75::DOUBLE), u IS NULL, v IS NULL, celsius IS NULL, dead IS NULL),
l AS (SELECT * FROM m UNPIVOT (d FOR f IN (u, v, celsius, humidity, dead))),
p AS (
  SELECT t, ty, tx, f, list({'y': y, 'x': x, 'd': d, 'n': n} ORDER BY y, x) AS p
  FROM l JOIN (SELECT DISTINCT y // 12 AS ty, x // 12 AS tx FROM c) g ON ty * 12 <= y + 9 AND ty * 12 + 12 > y - 9 AND tx * 12 <= x + 9 AND tx * 12 + 12 > x - 9 GROUP BY ALL),
""" + solves_sql(3.0, 0.35, 12) + """,
q AS (
  SELECT b.*, coalesce(any_value(o.c) FILTER (f = 'u'), 0) AS cu, coalesce(any_value(o.c) FILTER (f = 'v'), 0) AS cv, coalesce(any_value(s) FILTER (f = 'u'), 1) AS su,
    coalesce(any_value(o.c) FILTER (f = 'celsius'), 0) AS cc, coalesce(any_value(s) FILTER (f = 'celsius'), 1) AS sc, coalesce(any_value(o.c) FILTER (f = 'humidity'), 0) AS ch, coalesce(any_value(s) FILTER (f = 'humidity'), 1) AS sh,
    coalesce(any_value(o.c) FILTER (f = 'dead'), 0) AS cd, coalesce(any_value(s) FILTER (f = 'dead'), 1) AS sd
  FROM b LEFT JOIN o ON o.t = b.t AND o.y = b.y AND o.x = b.x GROUP BY ALL)
SELECT t AS minute, y, x, coalesce((SELECT count(*) FROM s WHERE s.t = q.t), 0) AS station_count, round(speed, 6) AS speed, round(dir, 6)::DOUBLE AS direction, round(cu, 6) AS u_correction, round(cv, 6) AS v_correction, round(su, 6) AS wind_sd,
  round(celsius + cc, 6) AS celsius, round(sc, 6) AS celsius_sd, round(greatest(0, least(100, humidity + ch)), 6) AS humidity, round(sh, 6) AS humidity_sd, round(greatest(0.01::DOUBLE, least(3, dead + cd)), 6) AS dead, round(sd, 6) AS dead_sd
FROM q
""",
    "q_surface_lookup": f"""
WITH b AS (SELECT p_brand, round(avg(p_retailprice), 2)::DOUBLE AS m FROM part GROUP BY p_brand),
l AS (
  SELECT p_brand AS surface, m, l_extendedprice::DOUBLE % 4500 - 400 AS a, l_quantity::DOUBLE / 45 AS f, [0, 800, 2000, 3500]::DOUBLE[] AS ax, [0, 0.5, 1]::DOUBLE[] AS fx, [1, 0.9, 0.75, 0.5]::DOUBLE[] AS top
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN b USING (p_brand)),
k AS (SELECT *, {_BRACKET.format(axis="ax", x="a")} AS i, {_BRACKET.format(axis="fx", x="f")} AS j FROM l),
w AS (SELECT *, (least(greatest(a, 0), 3500) - ax[i]) / (ax[i + 1] - ax[i]) AS s, (least(greatest(f, 0), 1) - fx[j]) / (fx[j + 1] - fx[j]) AS t FROM k),
v AS (
  SELECT *, list_sum(list_transform([[0, 0], [0, 1], [1, 0], [1, 1]], lambda o: (CASE o[1] WHEN 1 THEN s ELSE 1 - s END) * (CASE o[2] WHEN 1 THEN t ELSE 1 - t END) * (m / 20 - 3 * (i - 1 + o[1]) - 2 * (j - 1 + o[2]) * (j - 1 + o[2])))) AS speed,
    list_sum(list_transform([[0, 0], [0, 1], [1, 0], [1, 1]], lambda o: (CASE o[1] WHEN 1 THEN s ELSE 1 - s END) * (CASE o[2] WHEN 1 THEN t ELSE 1 - t END) * (m / 1000 - (i - 1 + o[1]) / 20.0::DOUBLE - (j - 1 + o[2]) / 50.0::DOUBLE))) AS endurance
  FROM w)
SELECT surface, a < 0 OR a > 3500 AS a_out, f < 0 OR f > 1 AS l_out, count(*) AS n, round(sum(speed), 3) AS true_airspeed_m_s, round(sum(endurance), 3) AS endurance_multiplier, round(sum((1 - s) * top[i] + s * top[i + 1]), 3) AS maximum_payload_fraction
FROM v GROUP BY ALL
""",
}
