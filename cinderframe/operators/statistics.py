"""Paired comparisons, weighted summaries, resampling and weights."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.sources.tables import checkpoint_folder


def paired(control: DataFrame, candidate: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that both sides have, with control, candidate and delta (candidate - control)."""
    a, b = control.select(*keys, F.col(value).alias("control")), candidate.select(*keys, F.col(value).alias("candidate"))
    return a.join(b, keys).withColumn("delta", F.col("candidate") - F.col("control"))


def unpaired(control: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with `side`."""
    only = lambda x, y, name: x.select(*keys).join(y.select(*keys), keys, "left_anti").withColumn("side", F.lit(name))
    return only(control, candidate, "control").union(only(candidate, control, "candidate"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def cluster_mean(rows: DataFrame, cluster: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean over clusters of their means (clusters weigh the same), the plain mean and counts."""
    by = by or []
    each = rows.groupBy(*by, cluster).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("n_clusters"), (F.sum("s") / F.sum("n")).alias("mean"), F.avg("m").alias("weighted_mean"))


def improvement_over(rows: DataFrame, keys: list[str], method: str, baseline: str, value: str) -> DataFrame:
    """rows of other methods with the baseline method's value at equal keys: base and gain (base - value)."""
    base = rows.filter(F.col(method) == baseline).select(*keys, F.col(value).alias("base"))
    return rows.filter(F.col(method) != baseline).join(base, keys).withColumn("gain", F.col("base") - F.col(value))


def signed_pairs(rows: DataFrame, keys: list[str], arm: str, treatment: str, control: str, value: str) -> DataFrame:
    """Per key, + treatment and - control summed; keys with one arm stay."""
    sign = F.when(F.col(arm) == treatment, 1).otherwise(-1)
    return rows.filter(F.col(arm).isin(treatment, control)).groupBy(*keys).agg(F.sum(sign * F.col(value)).alias("delta"), F.countDistinct(arm).alias("arms"))


def draw(replicate: Column, slot: Column, n: Column, seed: str) -> Column:
    """A reproducible draw from 0 to n - 1 for a slot of a replicate."""
    text = F.concat_ws(":", replicate.cast("string"), slot.cast("string"), F.lit(seed))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def mixed_bits(x: Column) -> Column:
    """A 32-bit number mixed into another, in arithmetic that every SQL engine has (xor, shift, multiplication modulo 2^32)."""
    x = x % (1 << 32)
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftright(x, 16)) * 73244475 % (1 << 32)
    return x.bitwiseXOR(F.shiftright(x, 16))


def bootstrap(clusters: DataFrame, value: str, order: str, replicates: int = 200, seed: int = 1, block: int = 4096) -> DataFrame:
    """(replicate, mean) of clusters drawn with replacement, as many as there are.

    clusters has one row per cluster; a drawn cluster without a value adds nothing. Clusters are numbered in `order`
    and cut into blocks, each one array of values. Every draw first falls on a block (by a number drawn from all
    clusters), and only counts are kept, added up before they are shuffled; then each block draws so many of its own
    values. So a row per block and replicate is shuffled, not a row per cluster and replicate.
    """
    ranked = numbered(clusters.select(order, value), order)
    blocks = ranked.groupBy(F.floor(F.col("number") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("number", F.col(value).cast("double").alias("v")))).alias("x"))
    blocks = blocks.select("block", F.col("x.v").alias("v"), F.size("x").alias("m"))
    n = clusters.count()
    slots = ranked.select("number", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    to = F.floor(mixed_bits(F.col("number") * 7919 + F.col("replicate") * 104729 + seed) % n / block)
    hits = slots.groupBy("replicate", to.alias("block")).agg(F.count("*").alias("k"))
    pick = lambda j: F.get(F.col("v"), (mixed_bits(mixed_bits(j * 15485863 + F.col("replicate")) + F.col("block") * 32452843 + seed) % F.col("m")).cast("int"))
    picks = F.sequence(F.lit(1).cast("long"), F.col("k"))
    total = F.aggregate(picks, F.lit(0.0), lambda a, j: a + F.coalesce(pick(j), F.lit(0.0)))
    empty = F.exists("v", lambda v: v.isNull())
    drawn = F.when(empty, F.aggregate(picks, F.lit(0).cast("long"), lambda a, j: a + F.when(pick(j).isNull(), 0).otherwise(1))).otherwise(F.col("k"))
    sums = hits.join(blocks, "block").select("replicate", total.alias("s"), drawn.alias("c"))
    return sums.groupBy("replicate").agg((F.sum("s") / F.sum("c")).alias("mean"))


def interval(means: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Bounds and share above zero of bootstrap means: a row per replicate goes in."""
    return means.agg(F.percentile("mean", F.array(F.lit(low), F.lit(high))).alias("q"), F.avg((F.col("mean") > 0).cast("double")).alias("above_zero")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "above_zero")


def numbered(rows: DataFrame, order: str | list[str], by: list[str] | None = None) -> DataFrame:
    """rows with `number` from 0 in order of columns that together are unique, within `by`.

    Rows are range-sorted and numbered inside each range; what stands in ranges before comes from a row per range and
    group. So no group is sorted by one task.
    """
    by, order = by or [], [order] if isinstance(order, str) else order
    checkpoint_folder(rows.sparkSession)
    # written once: ranges drawn a second time would have other bounds
    ranged = rows.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_n")).alias("_o")
    counts = counts.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_p").alias("_q"), before)
    same = F.col("_p") == F.col("_q")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    inside = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))
    return ranged.withColumn("_r", inside).join(counts, same).select(*rows.columns, (F.col("_o") + F.col("_r") - 1).alias("number"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], most: int = 100_000, buckets: int = 1024, discrete: bool = False) -> DataFrame:
    """Exact quantiles by group: by and a column for each name in shares, interpolated between the two nearest ranks; discrete,
    the least value with that share of rows at or below it.

    No group is brought together. Values are counted in `buckets` equal parts of the group's range; for each rank that
    is wanted only the part that holds it goes on, cut again while it has more than `most` rows that are not all
    equal. What is sorted in the end is such a part. Null and not-a-number values are left out; a group of none has
    no row.
    """
    checkpoint_folder(rows.sparkSession)
    key = F.struct(F.lit(0).alias("_0"), *by)  # nulls are groups like others
    x = rows.select(key.alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    spans = x.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in shares.items()}
    if discrete:  # the share as a fraction of whole numbers, so that ranks are exact
        parts = {name: Fraction(str(p)) for name, p in shares.items()}
        at = {name: F.greatest(F.lit(0).cast("long"), F.expr(f"(n * {p.numerator}L + {p.denominator - 1}L) div {p.denominator}L") - 1) for name, p in parts.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at.values()])))
    wanted = spans.withColumn("before", F.lit(0).cast("long")).withColumn("rank", F.explode(ranks)).withColumn("size", F.col("n"))
    while True:
        wanted = wanted.checkpoint()
        large = (F.col("size") > most) & (F.col("lo") < F.col("hi"))
        open_ = wanted.filter(large)
        if open_.isEmpty():
            break
        parts = open_.select("k", "lo", "hi", "before").distinct()
        inside = x.join(parts, "k").filter(F.col("v").between(F.col("lo"), F.col("hi")))
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves stay in range
        counts = inside.groupBy("k", "lo", "hi", "before", F.least(F.floor(share * buckets), F.lit(buckets - 1)).alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        w = Window.partitionBy("k", "lo").orderBy("b")
        counts = counts.withColumn("until", F.col("before") + F.sum("c").over(w)).select("k", "lo", "c", "least", "most", "until")
        found = open_.drop("size", "before").join(counts, ["k", "lo"]).filter((F.col("rank") < F.col("until")) & (F.col("rank") >= F.col("until") - F.col("c")))
        found = found.select("k", "n", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("until") - F.col("c")).alias("before"), "rank", F.col("c").alias("size"))
        wanted = wanted.filter(~large).unionByName(found)
    parts = wanted.filter("lo < hi").select("k", "lo", "hi", "before").distinct()
    inside = x.join(parts, "k").filter(F.col("v").between(F.col("lo"), F.col("hi")))
    inside = inside.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("k", "lo").orderBy("v")) - 1)
    ranked = inside.join(wanted.filter("lo < hi").select("k", "n", "lo", "rank"), ["k", "lo", "rank"]).select("k", "n", "rank", "v")
    ranked = ranked.union(wanted.filter("lo = hi").select("k", "n", "rank", F.col("lo").alias("v")))
    values = ranked.groupBy("k", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))  # two ranks a share

    def between(a: Column) -> Column:
        low = F.element_at("m", F.floor(a))
        return low + (a - F.floor(a)) * (F.element_at("m", F.ceil(a)) - low)

    return values.select(*[F.col(f"k.{c}").alias(c) for c in by], *[between(a).alias(name) for name, a in at.items()])


def matrix(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Long form of several value columns, summarised: by, metric, n, mean, low, high."""
    long = rows.select(*by, *values).unpivot(by, values, "metric", "v")
    return long.groupBy(*by, "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


def best_parameter(rows: DataFrame, keys: list[str], parameter: str, score: str) -> DataFrame:
    """The parameter with the greatest score, of equals the smallest."""
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(parameter)).alias("p"))).alias("m")).select(*keys, (-F.col("m.p")).alias(parameter), F.col("m.s").alias(score))


def log_weights(rows: DataFrame, keys: list[str], log_weight: str) -> DataFrame:
    """rows with `weight`, log weights normalised by key without overflow; uniform where none is finite."""
    x = F.when(F.isnan(log_weight) | (F.abs(F.col(log_weight)) == float("inf")), None).otherwise(F.col(log_weight))
    rows = rows.withColumn("_x", x)
    top = rows.groupBy(*keys).agg(F.max("_x").alias("_m"), F.count("*").alias("_n"))
    rows = rows.join(top, keys).withColumn("_w", F.when(F.col("_m").isNull(), 1.0).otherwise(F.coalesce(F.exp(F.col("_x") - F.col("_m")), F.lit(0.0))))
    total = rows.groupBy(*keys).agg(F.sum("_w").alias("_s"))
    return rows.join(total, keys).withColumn("weight", F.col("_w") / F.col("_s")).drop("_x", "_m", "_n", "_w", "_s")


def resample(rows: DataFrame, keys: list[str], order: str, weight: str, n: int, offset: float = 0.5) -> DataFrame:
    """Systematic resampling: keys, order and the times each row is drawn at positions (offset + i) / n of the running weight."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = rows.withColumn("_hi", F.sum(weight).over(w)).withColumn("_lo", F.col("_hi") - F.col(weight))
    at = lambda c: F.ceil(F.col(c) * n - offset)
    return x.withColumn("times", (F.least(at("_hi"), F.lit(n)) - F.greatest(at("_lo"), F.lit(0))).cast("long")).drop("_hi", "_lo")


def aggregate_skill(rows: DataFrame, by: list[str], score: str, reference: str) -> DataFrame:
    """(by, skill): 1 - mean score / mean reference over each group; a reference of zero gives infinity or not a number, as
    division does, and is not hidden."""
    s, r = F.avg(F.col(score).cast("double")), F.avg(F.col(reference).cast("double"))
    ratio = F.when(r != 0, s / r).when(s > 0, float("inf")).when(s < 0, float("-inf")).otherwise(float("nan"))
    return rows.groupBy(*by).agg((1 - ratio).alias("skill"))


def interval_coverage(rows: DataFrame, by: list[str], low: str, high: str, observed: str) -> DataFrame:
    """Per group, n, the share of observations inside [low, high], the intervals' mean width, and the shares below and above."""
    o, a, b = F.col(observed), F.col(low), F.col(high)
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(o.between(a, b)).alias("covered"), F.avg(b - a).alias("width"), share(o < a).alias("below"), share(o > b).alias("above"))


def skill(score: Column, reference: Column) -> Column:
    """1 - score / reference, null unless the reference is positive."""
    return F.when(reference > 0, 1 - score / reference)
