"""Audits, admissibility, selection, assignment and event logs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.operators import audit, selection as sel


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _split(rows: DataFrame) -> DataFrame:
    return audit.split_of(rows, "o_custkey", {1: "tune", 2: "test"}, F.year("o_orderdate"), {**{y: "tune" for y in range(1990, 1997)}, **{y: "test" for y in range(1997, 2010)}})


def q_split_rule(spark: SparkSession, d: str) -> DataFrame:
    return _split(_orders(spark, d)).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


def q_partition_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit.partition_audit(_split(_orders(spark, d)), "o_orderkey", "split", ["o_custkey", "o_orderpriority"])


def q_validation(spark: SparkSession, d: str) -> DataFrame:
    l = spark.read.parquet(f"{d}/lineitem.parquet")
    return audit.violations(l, ["l_returnflag"], {"discount": F.col("l_discount").between(0, 0.08), "quantity": F.col("l_quantity") <= 45, "price": F.col("l_extendedprice") > 1000})


def q_domain_audit(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    out = audit.domain_audit(e, ["event_type"], {"value": (1.0, 200.0), "k": (10.0, 90.0)})
    return out.select("event_type", "field", "n", "n_outside", F.round("share", 6).alias("share"))


def q_availability(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).alias("valid"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    start = F.lit(28406880)
    out = audit.availability(e.withColumn("out", F.col("valid") - 1440 + F.col("k")), "valid", "out", start, start + 2880, ["user_id"])
    return out.select("user_id", "n_inside", F.round("covered", 6).alias("covered"), "out_in_time", "class")


def q_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Sources named after years around the order's own, without a year, and not named."""
    year = F.year("o_orderdate")
    name = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("survey"), *[F.concat(F.lit("survey "), (year + k).cast("string")) for k in (-2, 0, 1)]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return _orders(spark, d).select(audit.provenance(name, year).alias("status"), year.alias("year")).groupBy("status", "year").agg(F.count("*").alias("n"))


def q_version_at(spark: SparkSession, d: str) -> DataFrame:
    versions = spark.createDataFrame([("v1", "1993-01-01", 1), ("v2", "1996-06-01", 2), ("v3", "1996-06-01", 3), ("v4", "1999-01-01", 4)], "version string, effective string, rank int").withColumn("effective", F.to_date("effective"))
    o = _orders(spark, d).select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return audit.latest_admissible(versions, o, "effective", "day", ["rank"], "version").groupBy("version").agg(F.count("*").alias("n"))


def q_forecast_cycle(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", audit.forecast_cycle(F.col("ts"), F.get_json_object("props", "$.k").cast("int") / 3).alias("cycle"))
    return e.select("event_id", "cycle", F.size(audit.repair_cycles(F.col("cycle"), 15)).cast("long").alias("n_repair"))


def q_nesting(spark: SparkSession, d: str) -> DataFrame:
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.year("l_shipdate").alias("year"), (F.col("l_partkey") % 50).alias("cell")).distinct()
    return audit.nesting(l, ["l_suppkey"], "year", ["cell"])


def q_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    required = e.select("user_id").distinct().withColumn("event_type", F.explode(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))))
    got = e.filter("value > 150").select("user_id", "event_type", F.lit(1.0).alias("score"))
    out = audit.coverage(required, got, ["user_id"], "event_type", "score")
    return out.select("user_id", "n_required", "n_closed", F.round("score", 6).alias("score"), F.array_join("open", ",").alias("open"))


def q_digest_tree(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "lang")
    after = docs.filter("lang <> 'es'").withColumn("digest", F.when(F.col("lang") == "fr", F.concat("digest", F.lit("x"))).otherwise(F.col("digest")))
    return audit.tree_changes(docs, after, "doc_id", "digest")


def q_last_wins(spark: SparkSession, d: str) -> DataFrame:
    l = spark.read.parquet(f"{d}/lineitem.parquet")
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return sel.latest(l, ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), *[F.desc(c) for c in rest]]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def q_round_robin(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal")
    q = sel.quartile(c, ["c_mktsegment"], "c_acctbal")
    return sel.round_robin(q, ["quartile", "c_mktsegment"], ["c_custkey"], 36).select("c_custkey", "c_mktsegment", "quartile", F.col("round").cast("long").alias("round"))


def q_systematic_frames(spark: SparkSession, d: str) -> DataFrame:
    n = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(sel.systematic(F.col("n"), 7)).alias("frame"))


def q_capacity_rank(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet")
    out = sel.capacity_rank(s, ["s_nationkey"], [F.desc("s_acctbal"), "s_suppkey"], F.lit(2))
    return out.select("s_suppkey", "rank", "accepted")


def q_queue_admission(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("age")).withColumn("bays", F.pmod("user_id", F.lit(20)))
    return sel.admit(e, ["event_type"], "age", "user_id", "bays").select("event_type", "user_id", "age")


def _offers(spark: SparkSession, d: str) -> DataFrame:
    l = spark.read.parquet(f"{d}/lineitem.parquet")
    return l.select((F.col("l_orderkey") % 500).alias("case"), (F.col("l_suppkey") % 5).alias("resource"), (F.col("l_partkey") % 6).alias("task"), "l_quantity").groupBy("case", "resource", "task").agg(F.sum("l_quantity").alias("value"))


def q_nearest_feasible(spark: SparkSession, d: str) -> DataFrame:
    return sel.nearest_feasible(_offers(spark, d), ["case", "resource"], "value", "task", F.col("value") >= 30)


def q_greedy_matching(spark: SparkSession, d: str) -> DataFrame:
    return sel.greedy_matching(_offers(spark, d), ["case"], "resource", "task", "value").groupBy("case").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def q_best_matching(spark: SparkSession, d: str) -> DataFrame:
    return sel.best_matching(_offers(spark, d), ["case"], "resource", "task", "value").groupBy("case").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def q_event_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count("event_id")).na.fill(0)


def q_payload_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long").getField("k")
    return _events(spark, d).groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"), F.count(k).alias("n"))


def q_causal_delivery(spark: SparkSession, d: str) -> DataFrame:
    """What was known at each purchase: the newest view (by sensing) that had been delivered, k minutes after it was sensed."""
    from cinderframe.operators import timeseries as ts

    e = _events(spark, d).withColumn("minute", ts.minutes("ts"))
    views = e.filter("event_type = 'view'").select("user_id", "event_id", F.col("minute").alias("sensed"), (F.col("minute") + F.get_json_object("props", "$.k").cast("double")).alias("minute"))
    from pyspark.sql import Window

    newest = F.max(F.struct("sensed", "event_id")).over(Window.partitionBy("user_id").orderBy("minute", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    views = views.withColumn("known", newest.getField("event_id")).select("user_id", "minute", "known")
    found = ts.bracket(views, e.filter("event_type = 'purchase'").select("event_id", "user_id", "minute"), ["user_id"], "minute")
    return found.select("event_id", F.coalesce("before.known", F.lit(-1)).alias("known"))


QUERIES = {f.__name__: f for f in (q_split_rule, q_partition_audit, q_validation, q_domain_audit, q_availability, q_provenance, q_version_at, q_forecast_cycle, q_nesting, q_coverage, q_digest_tree, q_last_wins, q_round_robin, q_systematic_frames, q_capacity_rank, q_queue_admission, q_nearest_feasible, q_greedy_matching, q_best_matching, q_event_kinds, q_payload_json, q_causal_delivery)}

_SPLIT = "WITH s AS (SELECT *, CASE WHEN o_custkey = 1 THEN 'tune' WHEN o_custkey = 2 THEN 'test' WHEN year(o_orderdate) BETWEEN 1990 AND 1996 THEN 'tune' WHEN year(o_orderdate) BETWEEN 1997 AND 2009 THEN 'test' END AS split FROM orders)"
_OFFERS = "WITH o AS (SELECT l_orderkey % 500 AS \"case\", l_suppkey % 5 AS resource, l_partkey % 6 AS task, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"

_MATCH = 'o AS (SELECT l_orderkey % 500 AS k, l_suppkey % 5 AS r, l_partkey % 6 AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)'


def _best_sql() -> str:
    """Resource by resource, for every set of taken tasks the picks of greatest total, of equal totals the first in order."""
    steps = [f"WITH {_MATCH}, s0 AS (SELECT DISTINCT k, 0 AS used, 0.0::DOUBLE AS total, []::BIGINT[] AS picks FROM o)"]
    for r in range(5):
        steps.append(f"""a{r} AS (SELECT * FROM s{r} UNION ALL SELECT s.k, used | (1 << t)::INT, total + v, list_append(picks, {r * 10} + t) FROM s{r} s JOIN o ON o.k = s.k AND o.r = {r} AND (used >> t) & 1 = 0),
s{r + 1} AS (SELECT k, used, total, picks FROM a{r} QUALIFY row_number() OVER (PARTITION BY k, used ORDER BY total DESC, picks) = 1)""")
    last = 'SELECT k AS "case", len(picks) AS n, round(total, 6) AS total FROM s5 QUALIFY row_number() OVER (PARTITION BY k ORDER BY s5.total DESC, picks) = 1'
    return ",\n".join(steps) + "\n" + last


SQL = {
    "q_split_rule": _SPLIT + "SELECT split, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM s GROUP BY split",
    "q_partition_audit": _SPLIT
    + """, c AS (SELECT o_custkey FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1), p AS (SELECT o_orderpriority FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT split, count(*) AS n_cases, count(*) - count(DISTINCT o_orderkey) AS n_repeated, count(DISTINCT o_custkey) FILTER (o_custkey IN (FROM c)) AS leaked_o_custkey,
       count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN (FROM p)) AS leaked_o_orderpriority FROM s GROUP BY split""",
    "q_validation": """
SELECT l_returnflag, unnest(['discount', 'quantity', 'price']) AS rule, unnest([count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.08::DOUBLE)), count(*) FILTER (l_quantity > 45), count(*) FILTER (l_extendedprice <= 1000)]) AS n_broken
FROM lineitem GROUP BY l_returnflag""",
    "q_domain_audit": """
WITH e AS (SELECT event_type, unnest(['value', 'k']) AS field, unnest([value, CAST(json_extract_string(props, '$.k') AS DOUBLE)]) AS v, unnest([1, 10]) AS lo, unnest([200, 90]) AS hi FROM events)
SELECT event_type, field, count(*) AS n, count(*) FILTER (v IS NULL OR v < lo OR v > hi) AS n_outside, round(count(*) FILTER (v IS NULL OR v < lo OR v > hi) / count(*), 6) AS share FROM e GROUP BY ALL""",
    "q_availability": """
WITH e AS (SELECT user_id, epoch_us(ts) // 60000000 AS v, epoch_us(ts) // 60000000 - 1440 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS o FROM events),
g AS (
  SELECT user_id, count(*) FILTER (v BETWEEN 28406880 AND 28409760) AS n_inside, min(v) FILTER (v BETWEEN 28406880 AND 28409760) AS a, max(v) FILTER (v BETWEEN 28406880 AND 28409760) AS b,
         coalesce(bool_and(o <= 28406880) FILTER (v BETWEEN 28406880 AND 28409760), false) AS t FROM e GROUP BY user_id)
SELECT user_id, n_inside, round(coalesce((b - a) / 2880.0::DOUBLE, 0), 6) AS covered, t AS out_in_time,
       CASE WHEN n_inside = 0 THEN 'missing' WHEN t THEN 'operational' WHEN coalesce((b - a) / 2880.0::DOUBLE, 0) >= 0.5 THEN 'retrospective' ELSE 'partial' END AS class FROM g""",
    "q_provenance": "SELECT ['unknown', 'unknown', 'undated', 'before_incident', 'same_year', 'after_incident'][(o_orderkey % 6 + 1)::INT] AS status, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY ALL",
    "q_version_at": """
SELECT CASE WHEN o_orderdate >= DATE '1999-01-01' THEN 'v4' WHEN o_orderdate >= DATE '1996-06-01' THEN 'v3' WHEN o_orderdate >= DATE '1993-01-01' THEN 'v1' END AS version, count(*) AS n FROM orders GROUP BY 1""",
    "q_forecast_cycle": """
WITH e AS (SELECT event_id, epoch_us(ts) // 3600000000 - 2 AS h, CAST(json_extract_string(props, '$.k') AS INT) / 3 AS hz FROM events),
c AS (SELECT event_id, (CASE WHEN hz > 18 THEN h - h % 6 ELSE h END)::BIGINT AS cycle FROM e)
SELECT event_id, cycle, (SELECT count(*) FROM range(0, 18, 6) r(i) WHERE cycle % 6 + i <= 15) AS n_repair FROM c""",
    "q_nesting": """
WITH f AS (SELECT DISTINCT l_suppkey, year(l_shipdate) AS year, l_partkey % 50 AS cell FROM lineitem),
o AS (SELECT l_suppkey, year, lead(year) OVER (PARTITION BY l_suppkey ORDER BY year) AS nxt FROM (SELECT DISTINCT l_suppkey, year FROM f)),
h AS (SELECT f.l_suppkey, nxt AS year, cell FROM f JOIN o USING (l_suppkey, year) WHERE nxt IS NOT NULL)
SELECT l_suppkey, count(*) AS lost_cells, count(DISTINCT year) AS frames FROM h ANTI JOIN f USING (l_suppkey, year, cell) GROUP BY l_suppkey""",
    "q_coverage": """
WITH k AS (SELECT DISTINCT user_id, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type FROM events), g AS (SELECT DISTINCT user_id, event_type, 1 AS s FROM events WHERE value > 150)
SELECT user_id, count(*) AS n_required, count(s) AS n_closed, round(avg(coalesce(s, 0)), 6) AS score, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (s IS NULL), '') AS open FROM k LEFT JOIN g USING (user_id, event_type) GROUP BY user_id""",
    "q_digest_tree": "SELECT doc_id, CASE lang WHEN 'es' THEN 'removed' WHEN 'fr' THEN 'changed' ELSE 'removed' END AS change FROM documents WHERE lang IS NULL OR lang IN ('es', 'fr')",
    "q_last_wins": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1""",
    "q_round_robin": """
WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer GROUP BY 1),
b AS (SELECT c_custkey, c_mktsegment, (c_acctbal > q[1])::INT + (c_acctbal > q[2])::INT + (c_acctbal > q[3])::INT AS quartile FROM customer JOIN q USING (c_mktsegment)),
r AS (SELECT *, row_number() OVER (PARTITION BY quartile, c_mktsegment ORDER BY c_custkey) AS round FROM b)
SELECT * FROM r ORDER BY round, quartile, c_mktsegment LIMIT 36""",
    "q_systematic_frames": """
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT DISTINCT user_id, floor(i * (n - 1) / 6.0::DOUBLE)::BIGINT AS frame FROM n, range(7) r(i)""",
    "q_capacity_rank": "WITH r AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) SELECT *, rank <= 2 AS accepted FROM r",
    "q_queue_admission": """
WITH e AS (SELECT user_id, event_type, count(*) AS age, user_id % 20 AS bays FROM events GROUP BY ALL)
SELECT event_type, user_id, age FROM e QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY age DESC, user_id) <= bays""",
    "q_nearest_feasible": _OFFERS + 'SELECT "case", resource, arg_min(task, (value, task)) FILTER (value >= 30) AS task, min(value) FILTER (value >= 30) AS value FROM o GROUP BY ALL',
    "q_event_kinds": "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id",
    "q_payload_json": "WITH k AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, sum(k)::BIGINT AS k_sum, max(k) AS k_max, count(k) AS n FROM k GROUP BY event_type",
    "q_causal_delivery": """
WITH v AS (SELECT user_id, event_id, epoch_us(ts) / 60000000.0 AS t, epoch_us(ts) / 60000000.0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS o FROM events WHERE event_type = 'view')
SELECT p.event_id, coalesce((SELECT arg_max(v.event_id, (v.t, v.event_id)) FROM v WHERE v.user_id = p.user_id AND v.o <= epoch_us(p.ts) / 60000000.0), -1) AS known FROM events p WHERE p.event_type = 'purchase'""",
    "q_greedy_matching": f"""
WITH RECURSIVE {_MATCH}, g(k, r, used, n, total) AS (
  SELECT DISTINCT k, 0, 0, 0, 0.0::DOUBLE FROM o UNION ALL
  SELECT g.k, g.r + 1, used | coalesce(1 << x.t, 0)::INT, n + (x.t IS NOT NULL)::INT, total + coalesce(x.v, 0)
  FROM g LEFT JOIN LATERAL (SELECT t, v FROM o WHERE o.k = g.k AND o.r = g.r AND (g.used >> t) & 1 = 0 ORDER BY v DESC, t LIMIT 1) x ON true WHERE g.r < 5)
SELECT k AS "case", n, total FROM g WHERE r = 5
""",
    "q_best_matching": _best_sql(),
}
