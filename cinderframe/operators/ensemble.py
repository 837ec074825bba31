"""Weighted ensembles: likelihoods of members, tempering, reduction to cells, particles and diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.operators import raster
from cinderframe.operators.statistics import draw, numbered


def perimeter_likelihood(predicted: DataFrame, observed: DataFrame, grid: DataFrame, keys: list[str], cell: float, sigma: float, area_sigma: float = 0.70) -> DataFrame:
    """Log-likelihood of each key's prediction: of the mean distance of the boundaries, and of the logarithm of the areas' ratio.

    Two empty sides have no distance; where one is empty it is the grid's diagonal. An empty area counts half a cell.
    """
    size = grid.groupBy(*keys).agg((F.max("y") - F.min("y") + 1).alias("_h"), (F.max("x") - F.min("x") + 1).alias("_w"))
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = size.join(count(predicted, "n_p"), keys, "left").join(count(observed, "n_o"), keys, "left").fillna(0, ["n_p", "n_o"])
    out = out.join(raster.boundary_gaps(predicted, observed, grid, keys, cell).groupBy(*keys).agg(F.avg("m").alias("mean_m")), keys, "left")
    residual = F.when((F.col("n_p") == 0) & (F.col("n_o") == 0), 0.0).when((F.col("n_p") == 0) | (F.col("n_o") == 0), F.hypot(F.col("_h"), F.col("_w")) * cell).otherwise(F.col("mean_m"))
    ratio = F.log(F.greatest(F.col("n_p").cast("double"), F.lit(0.5)) / F.greatest(F.col("n_o").cast("double"), F.lit(0.5)))
    out = out.select(*keys, residual.alias("boundary_residual_m"), ratio.alias("log_area_ratio"))
    half = lambda c, s: -0.5 * (F.col(c) / s) * (F.col(c) / s)
    out = out.withColumns({"boundary_log_likelihood": half("boundary_residual_m", sigma), "area_log_likelihood": half("log_area_ratio", area_sigma)})
    return out.withColumn("log_likelihood", F.col("boundary_log_likelihood") + F.col("area_log_likelihood"))


def growth_likelihood(predicted: DataFrame, observed: DataFrame, grid: DataFrame, keys: list[str], area_sigma: float = 1.50, f1_sigma: float = 0.45) -> DataFrame:
    """Log-likelihood of predicted growth: finite for empty sides by half a cell, and by the tolerance F1 (1 where both are empty)."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    out = grid.select(*keys).distinct().join(count(predicted, "n_p"), keys, "left").join(count(observed, "n_o"), keys, "left").fillna(0, ["n_p", "n_o"])
    out = out.join(raster.tolerance(predicted, observed, grid, keys).select(*keys, "f1"), keys, "left")
    f1 = F.when((F.col("n_p") == 0) & (F.col("n_o") == 0), 1.0).otherwise(F.coalesce("f1", F.lit(0.0)))
    ratio = F.log((F.col("n_p") + 0.5) / (F.col("n_o") + 0.5))
    out = out.select(*keys, ratio.alias("log_area_ratio"), f1.alias("tolerance_f1"))
    area, place = -0.5 * F.pow(F.col("log_area_ratio") / area_sigma, F.lit(2.0)), -0.5 * F.pow((1 - F.col("tolerance_f1")) / f1_sigma, F.lit(2.0))
    return out.withColumns({"area_log_likelihood": area, "localization_log_likelihood": place, "log_likelihood": area + place})


def reduce_members(cells: DataFrame, members: DataFrame, keys: list[str], cell: list[str], member: str, weight: str, arrival: str) -> DataFrame:
    """Per cell: weight of the members that burn it (a row with an arrival), and weighted mean and deviation of their arrivals.

    Weights of a key's members add up to one; a cell that no member burns has no row.
    """
    x = cells.filter(F.col(arrival).isNotNull()).join(members.select(*keys, member, weight), [*keys, member])
    w, t = F.col(weight), F.col(arrival)
    out = x.groupBy(*keys, *cell).agg(F.sum(w).alias("probability"), F.sum(w * t).alias("_s"))
    x = x.join(out, [*keys, *cell]).withColumn("_m", F.col("_s") / F.col("probability"))
    return x.groupBy(*keys, *cell).agg(F.max("probability").alias("probability"), F.max("_m").alias("arrival_mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(w * (t - F.col("_m")) * (t - F.col("_m"))) / F.sum(w))).alias("arrival_std"))


def tempered(rows: DataFrame, keys: list[str], member: str, log_weight: str, minimum: float = 0.35, steps: int = 48) -> DataFrame:
    """(keys, member, weight, beta, raw_ess): log weights to the greatest power beta up to 1 at which the effective number
    of members is at least `minimum` of all, by bisection.

    A key's members are one array: an ensemble of some hundred particles, not a table.
    """
    x = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(member).alias("m"), F.col(log_weight).cast("double").alias("l")))).alias("x"))

    def weights(beta: Column) -> Column:
        top = F.array_max(F.transform("x", lambda r: beta * r.l))
        raw = F.transform("x", lambda r: F.exp(beta * r.l - top))
        total = F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)
        return F.transform(raw, lambda r: r / total)

    ess = lambda beta: 1 / F.aggregate(weights(beta), F.lit(0.0), lambda a, b: a + b * b)
    target = minimum * F.size("x")
    x = x.withColumn("raw_ess", ess(F.lit(1.0)))

    def half(a: Column, _: Column) -> Column:
        mid = 0.5 * (a.lo + a.hi)
        enough = ess(mid) >= target
        return F.struct(F.when(enough, mid).otherwise(a.lo).alias("lo"), F.when(enough, a.hi).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), half, lambda a: a.lo)
    x = x.withColumn("beta", F.when(F.col("raw_ess") >= target, 1.0).otherwise(found))
    x = x.withColumn("w", weights(F.col("beta"))).select(*keys, "raw_ess", "beta", F.explode(F.arrays_zip("x", "w")).alias("p"))
    return x.select(*keys, F.col("p.x.m").alias(member), F.col("p.w").alias("weight"), "beta", "raw_ess")


def weight_diagnostics(rows: DataFrame, keys: list[str], weight: str, value: str, low: float, high: float, tolerance: float = 1e-9) -> DataFrame:
    """Per key: effective number of members, its share of all, greatest weight, and members whose value is at a bound of its range."""
    near = lambda b: F.abs(F.col(value) - b) <= tolerance + 1e-5 * abs(b)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))).alias("ess"), (F.max(weight) / F.sum(weight)).alias("top_share"), F.count_if(near(low) | near(high)).alias("at_bound"), F.bool_and(F.col(value).between(low, high)).alias("all_inside"))
    return out.withColumn("ess_share", F.col("ess") / F.col("n"))


def normal_draw(slot: Column, seed: str, steps: int = 1 << 20) -> Column:
    """A reproducible standard normal number for a slot (Box and Muller)."""
    u = (draw(F.lit("u"), slot, F.lit(steps), seed) + 1) / float(steps + 1)
    v = draw(F.lit("v"), slot, F.lit(steps), seed) / float(steps)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def particles(candidates: DataFrame, value: str, n: int, seed: str = "p") -> DataFrame:
    """n particles (particle, spread, wind_speed, wind_direction, moisture): candidates by equal strata of their order,
    dealt in a shuffled order, each with clipped jitter from a reproducible draw. Both orders are numbered by ranges, so
    neither candidates nor particles need be few."""
    m = candidates.count()
    ranked = numbered(candidates.select(F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("_i")), ["v", "_i"]).select(F.col("number").alias("r"), "v")
    slots = candidates.sparkSession.range(n).select(F.col("id").alias("stratum"), F.md5(F.concat_ws(":", "id", F.lit(seed))).alias("_h"))
    slots = numbered(slots, ["_h", "stratum"]).withColumn("r", F.least(F.floor((F.col("stratum") + 0.5) / n * m), F.lit(m - 1))).withColumnRenamed("number", "particle")
    x = slots.join(ranked, "r")
    jitter = lambda name, sd: sd * normal_draw(F.col("particle"), f"{seed}{name}")
    bounded = lambda c, a, b: F.greatest(F.lit(a), F.least(F.lit(b), c))
    return x.select("particle", (F.col("v") * F.exp(jitter("s", 0.06))).alias("spread"), bounded(F.exp(jitter("w", 0.18)), 0.60, 1.55).alias("wind_speed"), bounded(jitter("d", 14.0), -40.0, 40.0).alias("wind_direction"), bounded(jitter("m", 0.015), -0.045, 0.045).alias("moisture"))
