"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cinderframe.llm._frames import Scratch


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from the source's sizes (source, source_size), a row per source.

    Weights repeat over the sources in order of code point, null last. A source whose target would exceed
    `most` times its size stops there; the rest is shared again by weight until none is above. That end is a
    level: with sources ordered by cap over weight, the capped ones come first, and what they leave is split.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source, not per document
    out = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    budget = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    out = out.withColumn("wanted", (budget - before) / after * F.col("weight")).withColumn("capped", F.col("wanted") >= F.col("cap"))
    # the level grows up to the first source that is not capped and falls behind it: that source's level is the greatest
    level = F.max(F.when(~F.col("capped"), F.col("wanted") / F.col("weight"))).over(Window.partitionBy())
    return out.withColumn("level", level).select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def before_each(sums: DataFrame, keys: list[str], group: str, part: str, value: str) -> DataFrame:
    """sums (one row per keys, group and part) with `before`: the value of all earlier parts of the keys, in order of group
    and part. Totals are taken inside a group and over the groups, so no task sees all parts."""
    inside = Window.partitionBy(*keys, group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy(*keys, group).agg(F.sum(value).alias("group_sum"))
    groups = groups.select(*[F.col(k).alias(f"{k}_g") for k in (*keys, group)], F.coalesce(F.sum("group_sum").over(over), F.lit(0)).alias("group_before"))
    same = F.lit(True)
    for k in (*keys, group):
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_g"))
    out = sums.withColumn("part_before", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(groups, same)
    return out.select(*sums.columns, (F.col("part_before") + F.col("group_before")).alias("before"))


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: str = "mix", bucket_rows: int = 2_000, quantum: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the mix takes, source targets, and the sized documents (doc_id, source, size, copies).

    Every source is shuffled (by md5 of seed and doc_id) and queued up to `most` times over. Its documents are
    served in quanta of at most `quantum` words, and each quantum has a virtual finish time: the words of the
    source's queue up to its end over the source's target. All quanta of all sources are range-sorted by that
    time, and the running total is cut at the total budget, inside a quantum if need be. The first frame has
    (doc_id, source, size, copies, pass, taken, position): the words that a document's pass has before the cut
    and the place of its first one in the global order. Since sources finish words in proportion to their
    targets, each comes within about a quantum of its own.

    Quanta that begin at virtual time 1 or later lie behind the cut and are not made: those before hold the
    budget already. Running totals are taken inside hash buckets of about bucket_rows documents, and inside
    ranges of finish time with about as many quanta, and offset by those of earlier ones, in two steps: no
    source, bucket or range is one task. Rows with equal doc_id, source and size are copies: one row here,
    their number in `copies`, queued one behind the other.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    total = F.col("size") * F.col("copies")
    rows = scratch.cut(rows.withColumns({"key": F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), "total": total}))
    n = rows.count()
    digits = 1
    while n > bucket_rows * 16**digits and digits < 7:
        digits += 1
    rows = rows.withColumns({"group": F.left("key", F.lit(max(0, digits - 2))), "part": F.left("key", F.lit(digits))})
    sums = scratch.cut(rows.groupBy("source", "group", "part").agg(F.sum("total").alias("bucket_size")))
    goal = scratch.cut(targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most))
    budget = math.floor((goal.agg(F.sum("target")).first()[0] or 0.0) + 0.5)
    offsets = before_each(sums, ["source"], "group", "part", "bucket_size").join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    offsets = offsets.select(F.col("source").alias("s"), F.col("part").alias("p"), F.col("before").alias("offset"), "source_size", "target")
    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p", "group")
    inside = Window.partitionBy("source", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("begin", F.col("offset") + F.sum("total").over(inside) - F.col("total"))
    passes = placed.filter("total > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("begin", F.col("begin") + F.col("pass") * F.col("source_size")).filter("begin < target")
    quanta = passes.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("total") - 1, F.ceil(F.col("target") - F.col("begin")).cast("long") - 1), F.lit(quantum).cast("long"))))
    quanta = quanta.withColumn("words", F.least(F.lit(quantum).cast("long"), F.col("total") - F.col("at")))
    quanta = quanta.select("doc_id", "source", "size", "copies", "pass", "at", "words", ((F.col("begin") + F.col("at") + F.col("words")) / F.col("target")).alias("finish"))

    ranges = max(64, (budget // quantum + n) // bucket_rows)
    part = F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges)).cast("long")
    quanta = quanta.withColumns({"part": part, "group": F.shiftright(part, 10)})
    starts = before_each(quanta.groupBy("group", "part").agg(F.sum("words").alias("n")), [], "group", "part", "n").select(F.col("part").alias("p"), "before")
    by_finish = Window.partitionBy("part").orderBy("finish", "source", "doc_id", "size", "pass", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = quanta.join(starts, F.col("part") == F.col("p")).withColumn("position", F.col("before") + F.sum("words").over(by_finish) - F.col("words"))
    taken = ordered.filter(F.col("position") < budget).groupBy("doc_id", "source", "size", "copies", "pass").agg(F.sum(F.least("words", F.lit(budget) - F.col("position"))).alias("taken"), F.min("position").alias("position"))
    return taken, goal, rows.select("doc_id", "source", "size", "copies")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """What the mix takes from each document: id_col, size, source_size, target, taken and first_position.

    Sizes are word counts; see mix for the queueing and targets for the targets. taken counts the words of all
    passes; first_position is the place in words of the document's first taken word in the global order, -1 if
    it is not taken.

    Null texts have size 0 and take nothing. A null source is a source, last in order. Rows with equal id,
    source and size are copies and get equal shares, rounded so that they add up; null ids share one place
    in the shuffle. Sources of no words have target 0. Other columns are not read; empty in, empty out.
    """
    took, goal, rows = mix(docs, word_count(F.col(text_col)), id_col, source_col, weights, share, most)
    took = took.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("words"), F.min("position").alias("first_position"))
    took = took.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "words", "first_position")
    out = rows.join(took, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    out = out.join(goal.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g")))
    out = out.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    words = F.coalesce("words", F.lit(0))
    part = F.floor(words / F.col("copies")).cast("long")
    taken = part + F.when(F.col("k") <= words - part * F.col("copies"), 1).otherwise(0)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), F.coalesce("first_position", F.lit(-1)).alias("first_position"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """The documents of the mix with their columns: each whole, once per pass of which at least half is before the cut.

    Documents without words are in no mix; copies (see mix) take turns. Nulls, ties and empty tables: see mix_report.
    """
    took, _, _ = mix(docs, word_count(F.col(text_col)), id_col, source_col, weights, share, most)
    # copies take turns, so each gets the passes of all over their number
    times = took.groupBy("doc_id", "source", "size").agg(F.sum((F.col("taken") * 2 >= F.col("size") * F.col("copies")).cast("int")).alias("times")).filter("times > 0")
    times = times.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "times")
    # the rows are kept whole in a struct, so that no helper meets one of their columns
    sized = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    out = sized.join(times, F.col("id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    return out.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_source_mix": op9_source_mix}
SQL = {
    "op9_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM s),
x AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) * weight AS wanted FROM w),
g AS (
  SELECT source, source_size, least(coalesce(max(CASE WHEN wanted < cap THEN wanted / weight END) OVER () * weight, cap::DOUBLE), cap::DOUBLE) AS target FROM x),
p AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS b
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (
  SELECT p.*, n, b + n * source_size AS begin FROM p, (VALUES (0), (1), (2)) v(n) WHERE size > 0 AND b + n * source_size < target),
z AS (SELECT *, unnest(range(0, least(size - 1, ceil(target - begin)::BIGINT - 1) + 1, 100)) AS pos FROM q),
y AS (SELECT *, least(100, size - pos) AS words, CAST(begin + pos + least(100, size - pos) AS DOUBLE) / target AS finish FROM z),
o AS (
  SELECT *, CAST(sum(words) OVER (ORDER BY finish, source NULLS FIRST, doc_id NULLS FIRST, size, n, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - words AS position FROM y),
t AS (
  SELECT doc_id, sum(least(words, budget - position)) AS taken, min(position) AS first_position
  FROM o, (SELECT floor(sum(target) + 0.5)::BIGINT AS budget FROM g) WHERE position < budget GROUP BY doc_id)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, p.source_size, p.target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(first_position, -1) AS first_position
FROM p LEFT JOIN t ON p.doc_id = t.doc_id
""",
}
