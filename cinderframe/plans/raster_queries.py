"""Grid operators over the parts as a grid 40 cells wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.operators import raster, scoring
from cinderframe.plans.analysis_queries import solves_sql

CELL = 30.0


def _grid(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.lit("g").alias("incident"), F.floor(F.col("p_partkey") / 40).cast("int").alias("y"), (F.col("p_partkey") % 40).cast("int").alias("x"), "p_size", "p_type", F.col("p_retailprice").alias("height"))


K = ["incident"]


def _masks(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    return g.filter("p_size <= 10"), g.filter("p_size between 6 and 14")


def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.confusion(*_masks(_grid(spark, d)), K, CELL)
    return out.select("incident", *[F.round(c, 6).alias(c) for c in ("iou", "precision", "recall", "area_bias_km2")], "difference")


def q_dilate(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return raster.dilate(g.filter("p_size <= 2"), g, K, raster.disc(2.0)).select("y", "x")


def q_boundary(spark: SparkSession, d: str) -> DataFrame:
    return raster.boundary(_grid(spark, d).filter("p_size <= 25"), K).select("y", "x")


def q_tolerance_f1(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    out = raster.tolerance(g.filter("p_size <= 5"), g.filter("p_size between 4 and 8"), g, K)
    return out.select("incident", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def q_distance(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return raster.distance(g.filter("p_size = 1"), g, K).select("y", "x", F.round("d", 6).alias("d"))


def q_boundary_distance(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    out = raster.boundary_distances(g.filter("p_size <= 3"), g.filter("p_size between 20 and 23"), g, K, CELL)
    return out.select("incident", *[F.round(c, 6).alias(c) for c in ("mean_m", "q95_m", "max_m")])


def q_isotropic(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return raster.isotropic_growth(g.filter("p_size = 1"), g, K, 1.5, F.col("p_type") != "ECONOMY").select("y", "x")


def q_wind_ellipse(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return raster.dilate(g.filter("p_size = 1"), g, K, raster.ellipse(4.0, 2.0, 90.0)).select("y", "x")


def q_slope(spark: SparkSession, d: str) -> DataFrame:
    return raster.slope(_grid(spark, d), K, "height", CELL).select("y", "x", F.round("dy", 6).alias("dy"), F.round("dx", 6).alias("dx"))


def q_blur(spark: SparkSession, d: str) -> DataFrame:
    out = raster.blur(_grid(spark, d), K, "height", 0.8, "mean")
    return out.select("y", "x", F.round("mean", 6).alias("mean"))


def q_local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return raster.local_maxima(_grid(spark, d), K, "p_size", 2, 8).select("y", "x", "p_size", F.col("rank").cast("long").alias("rank"))


def q_drop_footprint(spark: SparkSession, d: str) -> DataFrame:
    drops = _grid(spark, d).filter("p_size = 1").select("y", "x", F.lit(30.0).alias("heading_deg"), F.lit(900.0).alias("volume"), F.concat_ws(":", "y", "x").alias("drop"))
    cells = raster.footprint(drops, ["drop"], 3, 2.0, 1.0)
    return cells.groupBy("y", "x").agg(F.round(F.sum("share"), 6).alias("coverage"))


def q_spread_step(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).withColumns({"burning": F.col("p_size") <= 10, "fuel": F.when(F.col("p_type") == "ECONOMY", 0.0).otherwise(F.col("height") / 1000)})
    return raster.spread_step(g, K, "burning", "fuel", 0.35).select("y", "x", F.round("p", 6).alias("p"))


def q_fuel_change(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("old"), F.when(F.col("p_type") == "ECONOMY", F.col("p_size") + 1).otherwise(F.col("p_size")).alias("new"))
    return p.groupBy("old", "new").agg(F.count("*").alias("cells"), F.max((F.col("old") != F.col("new")).cast("int")).alias("changed"))


def q_components(spark: SparkSession, d: str) -> DataFrame:
    from cinderframe.sources.tables import checkpoint_folder

    checkpoint_folder(spark)
    out = raster.component_labels(_grid(spark, d).filter("p_size <= 20"), K)
    return out.groupBy("label").agg(F.count("*").alias("cells"))


def q_optimal_interpolation(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    obs = g.filter("p_size = 1").select("incident", F.col("y").alias("oy"), F.col("x").alias("ox"), (F.col("height") / 1000).alias("innovation"))
    return raster.optimal_interpolation(obs, g, K, 2.0, 0.3).select("y", "x", F.round("correction", 6).alias("correction"), F.round("sd", 6).alias("sd"))


def q_geo_functions(spark: SparkSession, d: str) -> DataFrame:
    from cinderframe.functions import geo

    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name", (F.col("s_suppkey") * 3.5 % 360 - 180).alias("lon"), (F.col("s_suppkey") * 1.7 % 160 - 80).alias("lat"))
    mx, my = geo.web_mercator(F.col("lon"), F.col("lat"))
    square = [(-100.0, -40.0), (90.0, -40.0), (90.0, 50.0), (-100.0, 50.0)]
    return s.select("s_suppkey", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"), geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), geo.slug("s_name").alias("slug"), geo.state_prefix(F.concat(F.element_at(F.array(F.lit("CA-"), F.lit("OR_"), F.lit("no-")), (F.col("s_suppkey") % 3 + 1).cast("int")), "s_name")).alias("state"), geo.inside(F.col("lon"), F.col("lat"), square).alias("inside"), F.round(geo.table_lookup(F.col("lat"), [-50.0, 0.0, 30.0], [1.0, 4.0, 2.0]), 6).alias("looked_up"))


QUERIES = {f.__name__: f for f in (q_confusion, q_dilate, q_boundary, q_tolerance_f1, q_distance, q_boundary_distance, q_isotropic, q_wind_ellipse, q_slope, q_blur, q_local_maxima, q_drop_footprint, q_spread_step, q_fuel_change, q_components, q_optimal_interpolation, q_geo_functions)}

_G = "WITH g AS (SELECT (p_partkey // 40)::INT AS y, (p_partkey % 40)::INT AS x, p_size, p_type, p_retailprice AS height FROM part)"
_NEAR = "SELECT a.y, a.x, min(sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS d FROM {a} a, {b} b GROUP BY a.y, a.x"
_EDGE = "SELECT m.y, m.x FROM {m} m WHERE (SELECT count(*) FROM {m} n WHERE abs(n.y - m.y) + abs(n.x - m.x) = 1) < 4"
SQL = {
    "q_optimal_interpolation": _G.replace("WITH g", "WITH RECURSIVE g")
    + """, c AS (SELECT 0 AS t, y, x FROM g), l AS (SELECT y, x, height / 1000 AS d, 1 AS n FROM g WHERE p_size = 1),
p AS (SELECT 0 AS t, ty, tx, 'i' AS f, list({'y': y, 'x': x, 'd': d, 'n': n} ORDER BY y, x) AS p
  FROM l JOIN (SELECT DISTINCT y // 16 AS ty, x // 16 AS tx FROM c) z ON ty * 16 <= y + 12 AND ty * 16 + 16 > y - 12 AND tx * 16 <= x + 12 AND tx * 16 + 16 > x - 12 GROUP BY ALL),
""" + solves_sql(2.0, 0.3, 16) + """
SELECT g.y, g.x, round(coalesce(o.c, 0), 6) AS correction, round(coalesce(o.s, 1), 6) AS sd FROM g LEFT JOIN o ON o.y = g.y AND o.x = g.x""",
    "q_confusion": _G
    + """, n AS (SELECT count(*) FILTER (p_size <= 10) AS p, count(*) FILTER (p_size BETWEEN 6 AND 14) AS o, count(*) FILTER (p_size BETWEEN 6 AND 10) AS hit, count(*) FILTER (p_size <= 14) AS e FROM g)
SELECT 'g' AS incident, round(hit / greatest(e, 1), 6) AS iou, round(hit / greatest(p, 1), 6) AS precision, round(hit / greatest(o, 1), 6) AS recall, round((p - o) * 900.0 / 1e6, 6) AS area_bias_km2, e - hit AS difference FROM n""",
    "q_dilate": _G + "SELECT DISTINCT g.y, g.x FROM g JOIN g m ON m.p_size <= 2 AND (g.y - m.y) * (g.y - m.y) + (g.x - m.x) * (g.x - m.x) <= 4",
    "q_boundary": _G + ", m AS (SELECT y, x FROM g WHERE p_size <= 25) " + _EDGE.format(m="m"),
    "q_tolerance_f1": _G
    + """, p AS (SELECT y, x FROM g WHERE p_size <= 5), o AS (SELECT y, x FROM g WHERE p_size BETWEEN 4 AND 8),
r AS (SELECT (SELECT avg((EXISTS (SELECT 1 FROM o WHERE abs(o.y - p.y) + abs(o.x - p.x) <= 1))::INT) FROM p) AS pr, (SELECT avg((EXISTS (SELECT 1 FROM p WHERE abs(o.y - p.y) + abs(o.x - p.x) <= 1))::INT) FROM o) AS re)
SELECT 'g' AS incident, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / greatest(pr + re, 1e-12), 6) AS f1 FROM r""",
    "q_distance": _G + ", m AS (SELECT y, x FROM g WHERE p_size = 1), n AS (" + _NEAR.format(a="g", b="m") + ") SELECT y, x, round(d, 6) AS d FROM n",
    "q_boundary_distance": _G
    + ", p AS (SELECT y, x FROM g WHERE p_size <= 3), o AS (SELECT y, x FROM g WHERE p_size BETWEEN 20 AND 23), pe AS ("
    + _EDGE.format(m="p") + "), oe AS (" + _EDGE.format(m="o") + "), n AS (" + _NEAR.format(a="pe", b="oe") + " UNION ALL " + _NEAR.format(a="oe", b="pe")
    + ") SELECT 'g' AS incident, round(avg(d * 30), 6) AS mean_m, round(quantile_cont(d * 30, 0.95), 6) AS q95_m, round(max(d * 30), 6) AS max_m FROM n",
    "q_isotropic": _G + ", m AS (SELECT y, x FROM g WHERE p_size = 1) SELECT DISTINCT g.y, g.x FROM g, m WHERE g.p_size = 1 OR (g.p_type <> 'ECONOMY' AND (g.y - m.y) * (g.y - m.y) + (g.x - m.x) * (g.x - m.x) <= 2.25)",
    "q_wind_ellipse": _G + ", m AS (SELECT y, x FROM g WHERE p_size = 1) SELECT DISTINCT g.y, g.x FROM g, m WHERE (g.y = m.y AND g.x = m.x) OR pow((g.x - m.x - 2) / 2.0, 2) + pow((g.y - m.y) / 1.0, 2) <= 1 + 1e-9",
    "q_slope": _G
    + """, n AS (SELECT y, x, height, lag(height) OVER v AS a, lead(height) OVER v AS b, lag(height) OVER h AS c, lead(height) OVER h AS e FROM g WINDOW v AS (PARTITION BY x ORDER BY y), h AS (PARTITION BY y ORDER BY x))
SELECT y, x, round((coalesce(b, height) - coalesce(a, height)) / (30.0 * CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE 2 END), 6) AS dy, round((coalesce(e, height) - coalesce(c, height)) / (30.0 * CASE WHEN c IS NULL OR e IS NULL THEN 1 ELSE 2 END), 6) AS dx FROM n""",
    "q_blur": _G
    + """, m AS (SELECT max(y) AS my, max(x) AS mx FROM g),
o AS (SELECT g.y, g.x, greatest(0, least(my, g.y + a)) AS ny, greatest(0, least(mx, g.x + b)) AS nx, exp(-(a * a + b * b) / (2 * 0.8 * 0.8)::DOUBLE) AS w FROM g, m, range(-3, 4) s(a), range(-3, 4) t(b))
SELECT o.y, o.x, round(sum(n.height * w) / sum(w), 6) AS mean FROM o JOIN g n ON n.y = o.ny AND n.x = o.nx GROUP BY o.y, o.x""",
    "q_local_maxima": _G
    + """, p AS (SELECT a.y, a.x, a.p_size FROM g a JOIN g b ON abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL HAVING a.p_size = max(b.p_size))
SELECT y, x, p_size, row_number() OVER (ORDER BY p_size DESC, y, x) AS rank FROM p QUALIFY rank <= 8""",
    "q_drop_footprint": _G
    + """, c AS (
  SELECT d.y AS cy, d.x AS cx, d.y + a AS y, d.x + b AS x, exp(-0.5 * (pow(b * sin(radians(30)) - a * cos(radians(30)), 2) / 4 + pow(b * cos(radians(30)) + a * sin(radians(30)), 2))) AS w
  FROM g d, range(-3, 4) s(a), range(-3, 4) t(b) WHERE p_size = 1),
s AS (SELECT y, x, 900 * w / sum(w) OVER (PARTITION BY cy, cx) AS share FROM c)
SELECT y::INT AS y, x::INT AS x, round(sum(share), 6) AS coverage FROM s GROUP BY y, x""",
    "q_spread_step": _G
    + """, h AS (SELECT g.y, g.x, sum(1 / sqrt((g.y - b.y) * (g.y - b.y) + (g.x - b.x) * (g.x - b.x))) AS heat FROM g JOIN g b ON b.p_size <= 10 AND abs(g.y - b.y) <= 1 AND abs(g.x - b.x) <= 1 AND NOT (g.y = b.y AND g.x = b.x) GROUP BY g.y, g.x)
SELECT g.y, g.x, round(CASE WHEN p_size <= 10 THEN 1 ELSE 1 - exp(-0.35 * coalesce(heat, 0) * CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE height / 1000 END) END, 6) AS p FROM g LEFT JOIN h ON g.y = h.y AND g.x = h.x""",
    "q_fuel_change": "SELECT p_size AS old, CASE WHEN p_type = 'ECONOMY' THEN p_size + 1 ELSE p_size END AS new, count(*) AS cells, max((p_type = 'ECONOMY')::INT) AS changed FROM part GROUP BY ALL",
    "q_components": _G.replace("WITH g", "WITH RECURSIVE g")
    + """, m AS (SELECT y, x, y::BIGINT * 2147483648 + x AS id FROM g WHERE p_size <= 20),
r AS (SELECT y, x, id AS label FROM m UNION SELECT n.y, n.x, r.label FROM r JOIN m n ON abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1 WHERE r.label < n.id),
l AS (SELECT y, x, min(label) AS label FROM r GROUP BY y, x)
SELECT label, count(*) AS cells FROM l GROUP BY label""",
    "q_geo_functions": """
WITH s AS (SELECT s_suppkey, s_name, (s_suppkey * 3.5) % 360 - 180 AS lon, (s_suppkey * 1.7) % 160 - 80 AS lat FROM supplier)
SELECT s_suppkey, round(radians(lon) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) AS my, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(59, floor((lon + 180) / 6)) + 1)::INT AS epsg,
       regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, ['CA', 'OR', 'UNKNOWN'][(s_suppkey % 3 + 1)::INT] AS state, lon < 90 AND lon >= -100 AND lat >= -40 AND lat < 50 AS inside,
       round(CASE WHEN lat <= -50 THEN 1 WHEN lat <= 0 THEN 1 + (lat + 50) / 50 * 3 WHEN lat <= 30 THEN 4 - lat / 30 * 2 ELSE 2 END, 6) AS looked_up FROM s""",
}
