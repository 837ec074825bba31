"""Data-quality, leakage and admissibility audits, each as aggregates over the audited rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.operators.timeseries import bracket


def violations(rows: DataFrame, by: list[str], rules: dict[str, Column]) -> DataFrame:
    """Per group and rule, how many rows break it; a rule that gives null is broken."""
    counts = rows.groupBy(*by).agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.unpivot(by, list(rules), "rule", "n_broken")


def require(rows: DataFrame, ok: Column, message: str) -> DataFrame:
    """rows, failing when they are computed if any breaks ok."""
    return rows.filter(F.assert_true(ok, message).isNull())


def partition_audit(cases: DataFrame, case: str, split: str, exclusive: list[str]) -> DataFrame:
    """Per split: cases, repeated cases and, for each exclusive field, its values that other splits have too."""
    out = cases.groupBy(split).agg(F.count("*").alias("n_cases"), (F.count("*") - F.countDistinct(case)).alias("n_repeated"))
    for field in exclusive:
        pairs = cases.select(split, field).distinct()
        shared = pairs.groupBy(field).agg(F.count("*").alias("_k")).filter("_k > 1").select(field)
        leaks = pairs.join(shared, field, "left_semi").groupBy(split).agg(F.count("*").alias(f"leaked_{field}"))
        out = out.join(leaks, split, "left").withColumn(f"leaked_{field}", F.coalesce(f"leaked_{field}", F.lit(0)))
    return out


def split_of(rows: DataFrame, key: str, explicit: dict[int, str], year: Column, years: dict[int, str], strict: bool = True) -> DataFrame:
    """rows with `split`: what the explicit list says, else what the year's list says; else it fails when computed, or, if not strict, null."""
    def lookup(value: Column, table: dict[int, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value) if table else F.lit(None).cast("string")

    return rows.withColumn("split", F.coalesce(lookup(F.col(key), explicit), lookup(year, years), *([F.raise_error("no split for a row").cast("string")] if strict else [])))


def availability(rows: DataFrame, valid: str, available: str, start: Column, end: Column, by: list[str]) -> DataFrame:
    """Per group, how a forecast's inputs stand to its start: class, share of the window covered, whether all were out in time."""
    inside = F.col(valid).between(start, end)
    out = rows.groupBy(*by).agg(F.count_if(inside).alias("n_inside"), F.min(F.when(inside, F.col(valid))).alias("a"), F.max(F.when(inside, F.col(valid))).alias("b"), F.coalesce(F.bool_and(F.when(inside, F.col(available) <= start)), F.lit(False)).alias("out_in_time"))
    covered = F.coalesce((F.col("b") - F.col("a")) / (end - start), F.lit(0.0))
    kind = F.when(F.col("n_inside") == 0, "missing").when(F.col("out_in_time"), "operational").when(covered >= 0.5, "retrospective").otherwise("partial")
    return out.select(*by, "n_inside", covered.alias("covered"), "out_in_time", kind.alias("class"))


def domain_audit(rows: DataFrame, by: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Per group and column, values outside their bounds, null and not-a-number included, and their share."""
    long = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in bounds]).unpivot(by, list(bounds), "field", "v")
    low = F.element_at(F.create_map(*[F.lit(x) for c, (a, _) in bounds.items() for x in (c, float(a))]), F.col("field"))
    high = F.element_at(F.create_map(*[F.lit(x) for c, (_, b) in bounds.items() for x in (c, float(b))]), F.col("field"))
    bad = F.col("v").isNull() | F.isnan("v") | (F.col("v") < low) | (F.col("v") > high)
    return long.groupBy(*by, "field").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_outside")).withColumn("share", F.col("n_outside") / F.col("n"))


#: Words of a source's name that make it one of fuels.
FUEL_TOKENS = ("landfire", "fuel", "vegetation")


def names_fuel(name: Column) -> Column:
    """Whether a source's name speaks of fuels, whatever its case."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return sum((F.contains(low, F.lit(t)).cast("int") for t in FUEL_TOKENS), F.lit(0)) > 0


def forbidden_tuning(assignments: DataFrame, split: str, use: str, tunable: list[str]) -> DataFrame:
    """(split, n): assignments that are used for tuning though their split may not be."""
    return assignments.filter((F.col(use) == "tuning") & ~F.col(split).isin(*tunable)).groupBy(split).agg(F.count("*").alias("n"))


def provenance(text: Column, incident_year: Column) -> Column:
    """Status of a source named in text: by the first rule of four that holds."""
    year = F.regexp_extract(text, r"((?:19|20)\d{2})", 1)
    when = F.when(year != "", year.cast("int"))
    return F.when(text.isNull() | (text == ""), "unknown").when(when > incident_year, "after_incident").when(when == incident_year, "same_year").when(when.isNotNull(), "before_incident").otherwise("undated")


def latest_admissible(versions: DataFrame, cases: DataFrame, effective: str, at: str, order: list[str], what: str, chunk: float = 365.0) -> DataFrame:
    """cases with the version that was in force: of those effective (a date) at or before, the greatest by date and order; null
    where there is none.

    An as-of join in chunks of time, so neither versions nor cases need be few.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("double").alias("_at")
    best = versions.groupBy(day(effective)).agg(F.max(F.struct(*order, F.col(what).alias("_w"))).alias("_v")).withColumn("_k", F.lit(0))
    plain = [c for c in cases.columns if c != what]
    queries = cases.select(*plain, F.lit(0).alias("_k"), day(at)).filter(F.col(at).isNotNull())
    found = bracket(best, queries, ["_k"], "_at", chunk).select(*plain, F.col("before._v._w").alias(what))
    rest = cases.filter(F.col(at).isNull()).select(*plain, F.lit(None).cast(versions.schema[what].dataType).alias(what))
    return found.union(rest)


def forecast_cycle(issue: Column, horizon_hours: Column, lag_hours: int = 2, short_hours: int = 18, every: int = 6) -> Column:
    """The cycle (hours since 1970) that a forecast at issue can use: the last full hour before the lag; for
    horizons beyond short_hours the last one that is a multiple of `every`."""
    hour = F.floor(F.unix_micros(issue.cast("timestamp")) / 3_600_000_000) - lag_hours
    return F.when(horizon_hours > short_hours, hour - F.pmod(hour, F.lit(every))).otherwise(hour).cast("long")


def repair_cycles(start: Column, max_lead: int, every: int = 6) -> Column:
    """Cycles (hours since 1970) from which a missing hour may be repaired, the latest first."""
    top = start - F.pmod(start, F.lit(every))
    return F.filter(F.sequence(top, top - max_lead, F.lit(-every).cast("long")), lambda c: start - c <= max_lead)


def nesting(frames: DataFrame, keys: list[str], frame: str, cell: list[str]) -> DataFrame:
    """Per key, cells that a frame has and the next one has not: violations of growth, and frames that have them."""
    order = frames.select(*keys, frame).distinct().withColumn("_next", F.lead(frame).over(Window.partitionBy(*keys).orderBy(frame)))
    here = frames.select(*keys, frame, *cell).join(order.filter("_next is not null"), [*keys, frame]).select(*keys, F.col("_next").alias(frame), *cell)
    lost = here.join(frames.select(*keys, frame, *cell), [*keys, frame, *cell], "left_anti")
    return lost.groupBy(*keys).agg(F.count("*").alias("lost_cells"), F.countDistinct(frame).alias("frames"))


def coverage(required: DataFrame, evidence: DataFrame, keys: list[str], domain: str, score: str) -> DataFrame:
    """Per key, what share of the required domains has evidence and its mean score, with none counting 0."""
    got = evidence.groupBy(*keys, domain).agg(F.max(score).alias("_s"))
    out = required.select(*keys, domain).distinct().join(got, [*keys, domain], "left")
    return out.groupBy(*keys).agg(F.count("*").alias("n_required"), F.count("_s").alias("n_closed"), F.avg(F.coalesce("_s", F.lit(0.0))).alias("score"), F.array_sort(F.collect_list(F.when(F.col("_s").isNull(), F.col(domain)))).alias("open"))


def weighted_closure(evidence: DataFrame, keys: list[str], status: str, score: str, weight: str, statuses: list[str]) -> DataFrame:
    """Per key, the weighted mean score of its evidence (weights that are null count 1, scores that are null 0), whether every piece is
    closed (has a score), and how many have each status."""
    w, s = F.coalesce(F.col(weight), F.lit(1.0)), F.coalesce(F.col(score), F.lit(0.0))
    counts = [F.count_if(F.col(status) == x).alias(f"n_{x}") for x in statuses]
    return evidence.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.sum(w * s), F.sum(w)).alias("score"), F.bool_and(F.col(score).isNotNull()).alias("closed"), *counts)


def tree_changes(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """Paths that were changed, removed or added between two lists of digests, with `change`."""
    a, b = before.select(path, F.col(digest).alias("_a")), after.select(path, F.col(digest).alias("_b"))
    both = a.join(b, path, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(path, change.alias("change")).filter("change is not null")
