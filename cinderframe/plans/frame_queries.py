"""Frames, areas of unions, windows and resampling of grids, nearest places, and published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.operators import frames as fr, raster, spatial
from cinderframe.plans.raster_queries import _grid
from cinderframe.plans.stream_queries import scratch_folder
from cinderframe.sources import manifest

#: Greatest size of a part that belongs to each frame of a brand's progression.
SIZES = (1, 5, 5, 12, 10, 20, 20, 30)
_G = "g AS (SELECT p_partkey // 40 AS y, p_partkey % 40 AS x, p_size AS v FROM part)"


def _progression(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    sizes = F.array(*[F.struct(F.lit(k).alias("frame"), F.lit(s).alias("size")) for k, s in enumerate(SIZES)])
    cells = p.select("p_brand", "p_partkey", "p_size", F.explode(sizes).alias("f")).filter("p_size <= f.size").select("p_brand", F.col("f.frame").alias("frame"), "p_partkey")
    frames = p.select("p_brand").distinct().select("p_brand", F.explode(sizes).alias("f")).select("p_brand", F.col("f.frame").alias("frame"), (F.col("f.frame") * 20.0).alias("reported"))
    return fr.progression(frames, cells, ["p_brand"], "frame", ["p_partkey"])


def q_progression(spark: SparkSession, d: str) -> DataFrame:
    return _progression(spark, d).select("p_brand", "frame", "n_cells", "dormant", "fell", "lost")


def q_progression_audit(spark: SparkSession, d: str) -> DataFrame:
    out = fr.progression_audit(_progression(spark, d), ["p_brand"], "frame", "reported", 0.9)
    return out.select("p_brand", "n_frames", "n_filled", "n_dormant", "n_fell", "most_lost", *[F.round(c, 6).alias(c) for c in ("least_covered", "median_covered", "most_covered", "last_covered")])


def q_union_area(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of suppliers, many of which overlap or touch: the area that they cover together, by group of nations."""
    s, k = spark.read.parquet(f"{d}/supplier.parquet"), F.col("s_suppkey")
    x, y, w, h = k * 7 % 40 / 2.0, k * 31 % 60 / 4.0, 2.0 + k % 5, 1.0 + k % 4
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    shapes = s.select((F.col("s_nationkey") % 5).alias("grp"), F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h)).alias("polygon"))
    return fr.union_area(shapes, ["grp"], "polygon", 2.0).select("grp", F.round("area", 6).alias("area"))


def q_nearest_sphere(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's nearest supplier on the globe; half of the suppliers stand close together at the date line."""
    c, s = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    k, dense = F.col("s_suppkey"), F.col("s_suppkey") % 2 == 0
    lon = F.when(dense, 179.995 + k * 37 % 101 / 10000).otherwise(k * 97.7 % 360 - 180)
    places = s.select("s_suppkey", F.when(dense, 40 + k * 61 % 103 / 10000).otherwise(k * 17.3 % 170 - 85).alias("lat"), F.when(lon > 180, lon - 360).otherwise(lon).alias("lon"))
    k = F.col("c_custkey")
    points = c.select("c_custkey", (k * 13.7 % 180 - 90).alias("lat"), (k * 71.3 % 360 - 180).alias("lon"))
    return spatial.nearest_on_sphere(points, places, "c_custkey", "s_suppkey", 16).select("c_custkey", "s_suppkey", F.round("distance_km", 4).alias("km"))


def q_sliding(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).withColumn("v", F.col("p_size"))
    for size, how in ((3, "max"), (5, "mean"), (9, "min"), (9, "inner")):
        g = raster.sliding(g, ["incident"], "v", size, how, f"{how}{size}")
    return g.select("y", "x", "max3", F.round("mean5", 6).alias("mean5"), "min9", F.round("inner9", 6).alias("inner9"))


def _resampled(spark: SparkSession, d: str, method: str) -> DataFrame:
    g = _grid(spark, d).select("incident", "y", "x", F.col("p_size").cast("double").alias("v"))
    rows = g.agg(F.max("y")).first()[0] + 1
    out = raster.resample(g, ["incident"], "v", (rows, 40), (rows * 2, 27), method)
    return out.select("y", "x", F.round("v", 6).alias("v"))


def q_resample_area(spark: SparkSession, d: str) -> DataFrame:
    return _resampled(spark, d, "area")


def q_resample_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return _resampled(spark, d, "bilinear")


def q_resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _resampled(spark, d, "nearest")


def q_published(spark: SparkSession, d: str) -> DataFrame:
    """A job that publishes two thirds, is killed while it writes the rest, and runs again: every key stands once."""
    path = scratch_folder(spark, "published")
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    manifest.publish(o.filter("o_orderkey % 3 <> 0").withColumn("run", F.lit(1)), path, ["o_orderkey"], "c1")
    o.filter("o_orderkey % 2 = 0").withColumn("run", F.lit(2)).write.parquet(f"{path}/part-killed")  # in place, but without a manifest
    o.filter("o_orderkey % 2 = 1").withColumn("run", F.lit(2)).write.parquet(f"{path}/_staging-killed/data")
    manifest.publish(o.withColumn("run", F.lit(3)), path, ["o_orderkey"], "c1")
    rows = manifest.published(spark, path, "c1", ["o_orderkey"]).join(manifest.index(spark, path, "c1", ["o_orderkey"]), "o_orderkey")
    return rows.groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"), F.countDistinct("part").alias("parts"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {f.__name__: f for f in (q_progression, q_progression_audit, q_union_area, q_nearest_sphere, q_sliding, q_resample_area, q_resample_bilinear, q_resample_nearest, q_published)}

_PROGRESS = f"""
f AS (SELECT p_brand, f - 1 AS frame, {list(SIZES)}[f] AS size, (f - 1) * 20.0::DOUBLE AS reported FROM (SELECT DISTINCT p_brand FROM part), range(1, {len(SIZES) + 1}) t(f)),
l AS (SELECT f.p_brand, frame, any_value(reported) AS reported, count(p_partkey) AS n, coalesce(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey), '') AS ids FROM f LEFT JOIN part p ON p.p_brand = f.p_brand AND p_size <= size GROUP BY f.p_brand, frame),
w AS (SELECT *, coalesce(ids = lag(ids) OVER u, false) AS dormant, coalesce(n < lag(n) OVER u, false) AS fell, greatest(coalesce(lag(n) OVER u - n, 0), 0) AS lost FROM l WINDOW u AS (PARTITION BY p_brand ORDER BY frame))"""


def _resample_sql(w: str) -> str:
    weight = lambda c, t, old, new: w.format(c=c, t=t, s=f"({old} / {new}.0::DOUBLE)", old=old)
    return f"""
WITH {_G}, n AS (SELECT max(y) + 1 AS n FROM g),
ty AS (SELECT y, t AS ty, {weight("y", "t", "n", "(n * 2)").replace(".0::DOUBLE", "::DOUBLE")} AS wy FROM (SELECT DISTINCT y FROM g), n, range(0, 4000) r(t) WHERE t < n * 2),
tx AS (SELECT x, t AS tx, {weight("x", "t", 40, 27)} AS wx FROM range(0, 40) c(x), range(0, 27) r(t))
SELECT ty AS y, tx AS x, round(sum(v * wy * wx) / sum(wy * wx), 6) AS v FROM g JOIN ty USING (y) JOIN tx USING (x) WHERE wy > 1e-12 AND wx > 1e-12 GROUP BY ALL
"""


SQL = {
    "q_progression": f"WITH {_PROGRESS} SELECT p_brand, frame, n AS n_cells, dormant, fell, lost FROM w",
    "q_progression_audit": f"""
WITH {_PROGRESS}, c AS (SELECT *, CASE WHEN reported > 0 THEN n * 0.9::DOUBLE / reported END AS c FROM w)
SELECT p_brand, count(*) AS n_frames, count(*) FILTER (n > 0) AS n_filled, count(*) FILTER (dormant) AS n_dormant, count(*) FILTER (fell) AS n_fell, max(lost) AS most_lost,
  round(min(c), 6) AS least_covered, round(median(c), 6) AS median_covered, round(max(c), 6) AS most_covered, round(arg_max(c, frame), 6) AS last_covered FROM c GROUP BY p_brand
""",
    "q_union_area": """
WITH r AS (SELECT s_nationkey % 5 AS grp, k * 7 % 40 / 2.0::DOUBLE AS x0, k * 31 % 60 / 4.0::DOUBLE AS y0, 2 + k % 5 AS w, 1 + k % 4 AS h FROM (SELECT s_nationkey, s_suppkey AS k FROM supplier)),
b AS (SELECT grp, x0, x0 + w AS x1, y0, y0 + h AS y1 FROM r),
x AS (SELECT grp, x, lead(x) OVER (PARTITION BY grp ORDER BY x) AS nx FROM (SELECT grp, x0 AS x FROM b UNION SELECT grp, x1 FROM b)),
y AS (SELECT grp, y, lead(y) OVER (PARTITION BY grp ORDER BY y) AS ny FROM (SELECT grp, y0 AS y FROM b UNION SELECT grp, y1 FROM b))
SELECT grp, round(sum((nx - x) * (ny - y)), 6) AS area FROM x JOIN y USING (grp)
WHERE nx IS NOT NULL AND ny IS NOT NULL AND EXISTS (SELECT 1 FROM b WHERE b.grp = x.grp AND b.x0 <= x AND b.x1 >= nx AND b.y0 <= y AND b.y1 >= ny) GROUP BY grp
""",
    "q_nearest_sphere": """
WITH s AS (
  SELECT k, CASE WHEN k % 2 = 0 THEN 40 + k * 61 % 103 / 10000.0::DOUBLE ELSE k * 17.3::DOUBLE % 170 - 85 END AS lat, CASE WHEN k % 2 = 0 THEN 179.995::DOUBLE + k * 37 % 101 / 10000.0::DOUBLE ELSE k * 97.7::DOUBLE % 360 - 180 END AS lon
  FROM (SELECT s_suppkey AS k FROM supplier)),
p AS (SELECT c_custkey, radians(c_custkey * 13.7::DOUBLE % 180 - 90) AS a, radians(c_custkey * 71.3::DOUBLE % 360 - 180) AS b FROM customer),
d AS (SELECT c_custkey, k, 2 * 6371.0088::DOUBLE * asin(least(1, sqrt(pow(sin((a - radians(lat)) / 2), 2) + cos(a) * cos(radians(lat)) * pow(sin((b - radians(lon)) / 2), 2)))) AS km FROM p, s)
SELECT c_custkey, arg_min(k, (km, k)) AS s_suppkey, round(min(km), 4) AS km FROM d GROUP BY c_custkey
""",
    "q_sliding": f"""
WITH {_G}
SELECT a.y, a.x, max(b.v) FILTER (abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1) AS max3, round(sum(b.v) FILTER (abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2) / 25, 6) AS mean5, min(b.v) AS min9, round(avg(b.v), 6) AS inner9
FROM g a JOIN g b ON b.y BETWEEN a.y - 4 AND a.y + 4 AND b.x BETWEEN a.x - 4 AND a.x + 4 GROUP BY a.y, a.x
""",
    "q_resample_area": _resample_sql("greatest(0, least({c} + 1, ({t} + 1) * {s}) - greatest({c}, {t} * {s})) / {s}"),
    "q_resample_bilinear": _resample_sql("greatest(0, 1 - abs(greatest(0, least({old} - 1, ({t} + 0.5) * {s} - 0.5)) - {c}))"),
    "q_resample_nearest": _resample_sql("CASE WHEN least({old} - 1, floor({t} * {s})) = {c} THEN 1.0::DOUBLE ELSE 0 END"),
    "q_published": "SELECT CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 3 END AS run, count(*) AS n, count(DISTINCT o_orderkey) AS keys, 1::BIGINT AS parts, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
}
