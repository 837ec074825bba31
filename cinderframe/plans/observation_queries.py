"""Uncertain observations and weighted ensembles over the parts as a grid 40 cells wide; brands are members, sizes arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.operators import ensemble as en, observation as ob, raster
from cinderframe.plans.raster_queries import CELL, K, _grid


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with an arrival in minutes (none for size above 40) and a window by row of the grid."""
    g = _grid(spark, d)
    return g.select("incident", "y", "x", F.when(F.col("p_size") <= 40, F.col("p_size").cast("double")).alias("arrival"), (F.col("y") % 3 * 10.0).alias("start"), F.lit(30.0).alias("end"))


def q_acquired(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).withColumn("start", F.when(F.col("y") == 1, F.col("end")).otherwise(F.col("start")))
    p = ob.acquired_probability(F.col("arrival"), F.col("start"), F.col("end"))
    return c.select("y", "x", F.round(p, 8).alias("p"), F.round(ob.sensor_response(p, 0.9, 0.05), 8).alias("seen"))


def q_acquisition_study(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).withColumn("k", F.col("y") % 3).withColumn("start", F.col("k") * 10.0)
    out = ob.acquisition_study(c.select("k", "y", "x", "arrival", "start", "end"), ["k"], "arrival", "start", "end", samples=20)
    return out.select("k", "n", F.round("brier_window", 8).alias("brier_window"), F.round("brier_end", 8).alias("brier_end"))


def q_hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    a, b = ob.hourly_window(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    w = e.select(a.alias("a"), b.alias("b"), "value").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return w.select(F.date_format("a", "yyyy-MM-dd HH:mm").alias("a"), F.date_format("b", "yyyy-MM-dd HH:mm").alias("b"), "n", "mean")


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = _grid(spark, d)
    return g.filter("x between 8 and 20 and p_size > 3"), g.filter("x between 10 and 24"), g


def q_soft_perimeter(spark: SparkSession, d: str) -> DataFrame:
    _, seen, g = _sides(spark, d)
    far = F.col("d") * CELL
    return raster.signed_distance(seen, g, K).select("y", "x", F.round(ob.soft_occupancy(far, 45.0), 6).alias("p"), ob.within_envelope(far, 45.0).alias("inside"))


def q_uncertain_scores(spark: SparkSession, d: str) -> DataFrame:
    _, seen, g = _sides(spark, d)
    soft = raster.signed_distance(seen, g, K).select(*K, "y", "x", ob.soft_occupancy(F.col("d") * CELL, 45.0).alias("target"))
    x = soft.join(g.select(*K, "y", "x", (F.col("p_size") / 60.0).alias("p")), [*K, "y", "x"])
    return ob.uncertain_scores(x, K, "p", "target").select("incident", *[F.round(c, 6).alias(c) for c in ("soft_iou", "soft_brier", "cross_entropy")])


def q_envelope_coverage(spark: SparkSession, d: str) -> DataFrame:
    p, seen, g = _sides(spark, d)
    out = ob.envelope_coverage(p, seen, g, K, CELL, 45.0).withColumn("sigma", F.lit(45))
    return out.union(ob.envelope_coverage(p, seen, g, K, CELL, 0.0).withColumn("sigma", F.lit(0))).withColumn("coverage", F.round("coverage", 6))


def _three(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three cases on the grid: both sides, one side, none."""
    p, o, g = _sides(spark, d)
    case = lambda df, *names: df.withColumn("case", F.explode(F.array(*[F.lit(n) for n in names])))
    return case(p, "both", "one"), case(o, "both"), case(g, "both", "none", "one")


def q_perimeter_likelihood(spark: SparkSession, d: str) -> DataFrame:
    out = en.perimeter_likelihood(*_three(spark, d), ["case"], CELL, 60.0)
    return out.select("case", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def q_growth_likelihood(spark: SparkSession, d: str) -> DataFrame:
    out = en.growth_likelihood(*_three(spark, d), ["case"])
    return out.select("case", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _members(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.groupBy("p_brand", (F.col("p_partkey") % 3).alias("k")).agg((-F.avg("p_size") / 2).alias("log_weight"), F.avg("p_size").alias("size"))


def q_tempered(spark: SparkSession, d: str) -> DataFrame:
    out = en.tempered(_members(spark, d), ["k"], "p_brand", "log_weight")
    return out.select("k", "p_brand", *[F.round(c, 8).alias(c) for c in ("weight", "beta", "raw_ess")])


def q_reduced_members(spark: SparkSession, d: str) -> DataFrame:
    g = _cells(spark, d).join(_grid(spark, d).select("y", "x"), ["y", "x"]).select("y", "x", "arrival")
    m = spark.range(5).select(F.lit("e").alias("e"), F.col("id").alias("member"), ((F.col("id") + 1) / 15.0).alias("weight"))
    cells = g.select(F.lit("e").alias("e"), "y", (F.col("x") % 8).alias("x"), F.floor(F.col("x") / 8).alias("member"), "arrival")
    out = en.reduce_members(cells, m, ["e"], ["y", "x"], "member", "weight", "arrival")
    return out.select("y", "x", *[F.round(c, 8).alias(c) for c in ("probability", "arrival_mean", "arrival_std")])


def q_weight_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d).withColumn("w", F.exp("log_weight"))
    out = en.weight_diagnostics(m.withColumn("bounded", F.greatest(F.lit(20.0), F.least(F.lit(26.0), "size"))), ["k"], "w", "bounded", 20.0, 26.0)
    return out.select("k", "n", F.round("ess", 6).alias("ess"), F.round("top_share", 8).alias("top_share"), "at_bound", "all_inside", F.round("ess_share", 6).alias("ess_share"))


def q_member_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the members' areas, their weighted mean and extremes."""
    m = spark.read.parquet(f"{d}/part.parquet").groupBy("p_type", "p_brand").agg(F.count("*").alias("area"), F.avg("p_size").alias("w"))
    q = F.percentile("area", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = m.groupBy("p_type").agg(q.alias("q"), (F.sum(F.col("w") * F.col("area")) / F.sum("w")).alias("mean"), F.min("area").alias("low"), F.max("area").alias("high"))
    return out.select("p_type", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("p10", "p50", "p90"))], F.round("mean", 6).alias("mean"), "low", "high")


def q_particles(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/region.parquet").select((F.col("r_regionkey") * 0.25 + 0.5).alias("v"))
    out = en.particles(c, "v", 40)
    return out.select("particle", *[F.round(x, 6).alias(x) for x in ("spread", "wind_speed", "wind_direction", "moisture")])


QUERIES = {f.__name__: f for f in (q_acquired, q_acquisition_study, q_hourly_windows, q_soft_perimeter, q_uncertain_scores, q_envelope_coverage, q_perimeter_likelihood, q_growth_likelihood, q_tempered, q_reduced_members, q_weight_diagnostics, q_member_quantiles, q_particles)}

_G = "g AS (SELECT p_partkey // 40 AS y, p_partkey % 40 AS x, p_size, p_brand FROM part)"
_O = "o AS (SELECT y, x FROM g WHERE x BETWEEN 10 AND 24), p AS (SELECT y, x FROM g WHERE x BETWEEN 8 AND 20 AND p_size > 3)"
#: Distance to the observed cells outside, minus that to the others inside.
_SIGNED = """
s AS (
  SELECT g.y, g.x, CASE WHEN g.x BETWEEN 10 AND 24
    THEN -(SELECT min(sqrt((r.y - g.y) ** 2 + (r.x - g.x) ** 2)) FROM g r WHERE r.x NOT BETWEEN 10 AND 24)
    ELSE (SELECT min(sqrt((r.y - g.y) ** 2 + (r.x - g.x) ** 2)) FROM o r) END * 30.0 AS d FROM g)"""
_CDF = "CASE WHEN z >= 0 THEN 1 - exp(-z * z / 2) / 2.5066282746310002::DOUBLE * q ELSE exp(-z * z / 2) / 2.5066282746310002::DOUBLE * q END"
_SOFT = f"""
z AS (SELECT y, x, d, -d / 45.0::DOUBLE AS z, 1 / (1 + 0.2316419::DOUBLE * abs(-d / 45.0::DOUBLE)) AS t FROM s),
q AS (SELECT *, t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS q FROM z),
soft AS (SELECT y, x, d, {_CDF} AS p FROM q)"""
_EDGES = """
{0}b AS (SELECT m.y, m.x FROM {0} m WHERE (SELECT count(*) FROM {0} n WHERE abs(n.y - m.y) + abs(n.x - m.x) = 1) < 4)"""
_MEMBERS = "m AS (SELECT p_brand, p_partkey % 3 AS k, -avg(p_size) / 2 AS l, avg(p_size) AS size FROM part GROUP BY ALL)"
_BRIER = "CASE WHEN arrival IS NULL THEN 0 ELSE greatest(0, least(1, (30.0 - arrival) / (30.0 - start))) END"
_U = "CAST(('0x' || substr(md5(concat_ws(':', {0}, {1}, {2})), 1, 8)) AS BIGINT)"


def _normal(name: str) -> str:
    u, v = _U.format("'u'", "CAST(particle AS VARCHAR)", f"'p{name}'"), _U.format("'v'", "CAST(particle AS VARCHAR)", f"'p{name}'")
    return f"sqrt(-2 * ln(({u} % 1048576 + 1) / 1048577.0::DOUBLE)) * cos(2 * pi() * ({v} % 1048576) / 1048576.0::DOUBLE)"


SQL = {
    "q_acquired": f"""
WITH {_G}, c AS (SELECT y, x, CASE WHEN p_size <= 40 THEN p_size::DOUBLE END AS arrival, CASE WHEN y = 1 THEN 30.0 ELSE y % 3 * 10.0 END::DOUBLE AS start FROM g),
p AS (SELECT y, x, CASE WHEN arrival IS NULL THEN 0 WHEN start >= 30 THEN (arrival <= 30)::INT ELSE greatest(0, least(1, (30 - arrival) / (30 - start))) END AS p FROM c)
SELECT y, x, round(p, 8) AS p, round(0.05 + (0.9 - 0.05) * p, 8) AS seen FROM p
""",
    "q_acquisition_study": f"""
WITH {_G}, c AS (SELECT y % 3 AS k, CASE WHEN p_size <= 40 THEN p_size::DOUBLE END AS arrival, (y % 3 * 10)::DOUBLE AS start FROM g),
t AS (SELECT k, s, k * 10 + (30 - k * 10) * ({_U.format("CAST(k AS VARCHAR)", "CAST(s AS VARCHAR)", "'acq'")} % 10000 / 10000.0::DOUBLE) AS instant FROM (SELECT DISTINCT k FROM c), range(20) r(s)),
x AS (SELECT c.k, coalesce(arrival <= instant, false)::INT AS truth, {_BRIER} AS p, coalesce(arrival <= 30, false)::INT AS last FROM c JOIN t USING (k))
SELECT k, count(*) AS n, round(avg((p - truth) ** 2), 8) AS brier_window, round(avg((last - truth) ** 2), 8) AS brier_end FROM x GROUP BY k
""",
    "q_hourly_windows": """
SELECT strftime(date_trunc('hour', ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS a, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS b, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL
""",
    "q_soft_perimeter": f"WITH {_G}, {_O}, {_SIGNED}, {_SOFT} SELECT y, x, round(p, 6) AS p, abs(d) <= 1.959963984540054::DOUBLE * 45 AS inside FROM soft",
    "q_uncertain_scores": f"""
WITH {_G}, {_O}, {_SIGNED}, {_SOFT}, j AS (SELECT soft.p AS t, p_size / 60.0::DOUBLE AS a, greatest(1e-6, least(1 - 1e-6, p_size / 60.0::DOUBLE)) AS c FROM soft JOIN g USING (y, x))
SELECT 'g' AS incident, round(sum(least(a, t)) / sum(greatest(a, t)), 6) AS soft_iou, round(avg((a - t) ** 2), 6) AS soft_brier, round(avg(-(t * ln(c) + (1 - t) * ln(1 - c))), 6) AS cross_entropy FROM j
""",
    "q_envelope_coverage": f"""
WITH {_G}, {_O}, {_SIGNED}, {_EDGES.format("p")}, {_EDGES.format("o")},
n AS (SELECT count(*) AS n, count(*) FILTER (abs(d) <= 1.959963984540054::DOUBLE * 45) AS a, (SELECT count(*) FROM pb JOIN ob USING (y, x)) AS b FROM pb JOIN s USING (y, x))
SELECT 'g' AS incident, n AS n_boundary, a AS n_inside, round(a / n, 6) AS coverage, 45 AS sigma FROM n UNION ALL SELECT 'g', n, b, round(b / n, 6), 0 FROM n
""",
    "q_perimeter_likelihood": f"""
WITH {_G}, {_O}, {_EDGES.format("p")}, {_EDGES.format("o")},
dist AS (
  SELECT (SELECT min(sqrt((ob.y - pb.y) ** 2 + (ob.x - pb.x) ** 2)) FROM ob) * 30 AS m FROM pb UNION ALL
  SELECT (SELECT min(sqrt((ob.y - pb.y) ** 2 + (ob.x - pb.x) ** 2)) FROM pb) * 30 FROM ob),
c AS (
  SELECT 'both' AS case, (SELECT avg(m) FROM dist) AS r, ln((SELECT count(*) FROM p) / (SELECT count(*) FROM o)) AS a
  UNION ALL SELECT 'one', sqrt((max(y) + 1) ** 2 + (max(x) + 1) ** 2) * 30, ln((SELECT count(*) FROM p) / 0.5) FROM g UNION ALL SELECT 'none', 0, 0)
SELECT "case", round(r, 6) AS boundary_residual_m, round(a, 6) AS log_area_ratio, round(-0.5 * (r / 60) ** 2, 6) AS boundary_log_likelihood, round(-0.5 * (a / 0.7) ** 2, 6) AS area_log_likelihood,
       round(-0.5 * (r / 60) ** 2 - 0.5 * (a / 0.7) ** 2, 6) AS log_likelihood FROM c
""",
    "q_growth_likelihood": f"""
WITH {_G}, {_O}, n AS (
  SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM o) AS no,
         (SELECT count(*) FROM p WHERE EXISTS (SELECT 1 FROM o WHERE (o.y - p.y) ** 2 + (o.x - p.x) ** 2 <= 1)) / (SELECT count(*) FROM p) AS pr,
         (SELECT count(*) FROM o WHERE EXISTS (SELECT 1 FROM p WHERE (o.y - p.y) ** 2 + (o.x - p.x) ** 2 <= 1)) / (SELECT count(*) FROM o) AS re),
c AS (SELECT 'both' AS case, ln((np + 0.5) / (no + 0.5)) AS a, 2 * pr * re / greatest(pr + re, 1e-12) AS f FROM n UNION ALL SELECT 'one', ln((np + 0.5) / 0.5), 0 FROM n UNION ALL SELECT 'none', 0, 1)
SELECT "case", round(a, 6) AS log_area_ratio, round(f, 6) AS tolerance_f1, round(-0.5 * (a / 1.5) ** 2, 6) AS area_log_likelihood, round(-0.5 * ((1 - f) / 0.45) ** 2, 6) AS localization_log_likelihood,
       round(-0.5 * (a / 1.5) ** 2 - 0.5 * ((1 - f) / 0.45) ** 2, 6) AS log_likelihood FROM c
""",
    "q_tempered": f"""
WITH RECURSIVE {_MEMBERS}, n AS (SELECT k, count(*) AS n, max(l) AS top FROM m GROUP BY k),
raw AS (SELECT k, sum(exp(l - top)) ** 2 / sum(exp(l - top) ** 2) AS ess FROM m JOIN n USING (k) GROUP BY k),
b(k, i, lo, hi) AS (
  SELECT k, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM n UNION ALL
  SELECT b.k, i + 1, CASE WHEN e.ess >= 0.35 * n.n THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e.ess >= 0.35 * n.n THEN hi ELSE (lo + hi) / 2 END
  FROM b JOIN n ON n.k = b.k, LATERAL (SELECT sum(exp((lo + hi) / 2 * (l - top))) ** 2 / sum(exp((lo + hi) / 2 * (l - top)) ** 2) AS ess FROM m WHERE m.k = b.k) e WHERE i < 48),
f AS (SELECT b.k, CASE WHEN raw.ess >= 0.35 * n.n THEN 1.0 ELSE lo END AS beta, raw.ess FROM b JOIN raw ON raw.k = b.k JOIN n ON n.k = b.k WHERE i = 48)
SELECT m.k, p_brand, round(exp(beta * (l - top)) / sum(exp(beta * (l - top))) OVER (PARTITION BY m.k), 8) AS weight, round(beta, 8) AS beta, round(ess, 8) AS raw_ess
FROM m JOIN f ON f.k = m.k JOIN n ON n.k = m.k
""",
    "q_reduced_members": """
WITH c AS (SELECT p_partkey // 40 AS y, p_partkey % 40 % 8 AS x, (p_partkey % 40 // 8 + 1) / 15.0::DOUBLE AS w, p_size::DOUBLE AS t FROM part WHERE p_size <= 40),
m AS (SELECT y, x, sum(w) AS p, sum(w * t) / sum(w) AS mean FROM c GROUP BY y, x)
SELECT c.y, c.x, round(any_value(p), 8) AS probability, round(any_value(mean), 8) AS arrival_mean, round(sqrt(greatest(0, sum(w * (t - mean) ** 2) / sum(w))), 8) AS arrival_std FROM c JOIN m ON c.y = m.y AND c.x = m.x GROUP BY c.y, c.x
""",
    "q_weight_diagnostics": f"""
WITH {_MEMBERS}, x AS (SELECT k, exp(l) AS w, greatest(20.0, least(26.0, size)) AS b FROM m)
SELECT k, count(*) AS n, round(sum(w) ** 2 / sum(w * w), 6) AS ess, round(max(w) / sum(w), 8) AS top_share, count(*) FILTER (abs(b - 20) <= 0.000200001 OR abs(b - 26) <= 0.000260001) AS at_bound,
       bool_and(b BETWEEN 20 AND 26) AS all_inside, round(sum(w) ** 2 / sum(w * w) / count(*), 6) AS ess_share FROM x GROUP BY k
""",
    "q_member_quantiles": """
WITH m AS (SELECT p_type, p_brand, count(*) AS area, avg(p_size) AS w FROM part GROUP BY ALL)
SELECT p_type, round(quantile_cont(area, 0.1), 6) AS p10, round(quantile_cont(area, 0.5), 6) AS p50, round(quantile_cont(area, 0.9), 6) AS p90, round(sum(w * area) / sum(w), 6) AS mean, min(area) AS low, max(area) AS high FROM m GROUP BY p_type
""",
    "q_particles": f"""
WITH c AS (SELECT row_number() OVER (ORDER BY r_regionkey) AS r, count(*) OVER () AS m, r_regionkey * 0.25::DOUBLE + 0.5 AS v FROM region),
s AS (SELECT stratum, row_number() OVER (ORDER BY md5(concat_ws(':', CAST(stratum AS VARCHAR), 'p'))) - 1 AS particle FROM range(40) t(stratum)),
x AS (SELECT particle, v FROM s JOIN c ON least(floor((stratum + 0.5) / 40 * m), m - 1) + 1 = r)
SELECT particle, round(v * exp(0.06 * {_normal("s")}), 6) AS spread, round(greatest(0.6, least(1.55, exp(0.18 * {_normal("w")}))), 6) AS wind_speed,
       round(greatest(-40.0, least(40.0, 14.0 * {_normal("d")})), 6) AS wind_direction, round(greatest(-0.045, least(0.045, 0.015 * {_normal("m")})), 6) AS moisture FROM x
""",
}
