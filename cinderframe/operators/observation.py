"""Observations of uncertain time and place: acquisition windows, sensors, soft perimeters and their scores."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from cinderframe.operators import raster
from cinderframe.operators.statistics import draw

# A published approximation of the normal distribution (error below 8e-8): scale and five coefficients.
NORMAL_SCALE, NORMAL_TERMS = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + NORMAL_SCALE * F.abs(z))
    series = F.lit(0.0)
    for c in reversed(NORMAL_TERMS):
        series = t * (c + series)
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * series
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def acquired_probability(arrival: Column, start: Column, end: Column) -> Column:
    """Probability that a cell had burned at an unknown instant of [start, end]; without arrival 0, without duration a step."""
    spread = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (end - arrival) / (end - start)))
    return F.when(arrival.isNull() | F.isnan(arrival), 0.0).when(start >= end, (arrival <= end).cast("double")).otherwise(spread)


def hourly_window(at: Column) -> tuple[Column, Column]:
    """The hour before a product's time stamp, in which it was acquired."""
    return at - F.expr("INTERVAL 1 HOUR"), at


def sensor_response(p: Column, detection: float, false_alarm: float) -> Column:
    """Probability that a sensor reports a cell that burns with probability p."""
    if not 0 <= false_alarm < detection <= 1:
        raise ValueError("false alarms must be rarer than detections")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), false_alarm + (detection - false_alarm) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))))


def soft_occupancy(signed_distance: Column, sigma: float) -> Column:
    """Probability that a cell is inside a perimeter of Gaussian error, from the distance to it (negative inside)."""
    return (signed_distance <= 0).cast("double") if sigma == 0 else normal_cdf(-signed_distance / sigma)


def within_envelope(signed_distance: Column, sigma: float, confidence: float = 0.95) -> Column:
    """Whether the boundary may run through a cell at the confidence level; nowhere without error."""
    return F.lit(False) if sigma == 0 else F.abs(signed_distance) <= NormalDist().inv_cdf(0.5 + confidence / 2) * sigma


def uncertain_scores(rows: DataFrame, by: list[str], p: str, target: str, epsilon: float = 1e-6) -> DataFrame:
    """Soft overlap, soft Brier score and cross-entropy of a probability against an occupancy probability."""
    a, b = F.col(p), F.col(target)
    c = F.greatest(F.lit(epsilon), F.least(F.lit(1 - epsilon), a))
    entropy = -(b * F.log(c) + (1 - b) * F.log1p(-c))
    overlap = F.sum(F.least(a, b)) / F.greatest(F.sum(F.greatest(a, b)), F.lit(epsilon))
    return rows.groupBy(*by).agg(overlap.alias("soft_iou"), F.avg((a - b) * (a - b)).alias("soft_brier"), F.avg(entropy).alias("cross_entropy"))


def envelope_coverage(predicted: DataFrame, observed: DataFrame, grid: DataFrame, keys: list[str], cell: float, sigma: float, confidence: float = 0.95) -> DataFrame:
    """Share of the predicted boundary inside the observation's envelope: n_boundary, n_inside and coverage, for every key of the grid.

    Without error the envelope is the observed boundary itself. Without a predicted boundary the coverage is 1 if
    nothing was observed, else 0.
    """
    at = [*keys, "y", "x"]
    edge = raster.boundary(predicted, keys)
    if sigma == 0:
        allowed = raster.boundary(observed, keys)
    else:
        allowed = raster.signed_distance(observed, grid, keys).filter(within_envelope(F.col("d") * cell, sigma, confidence)).select(*at)
    hit = edge.join(allowed.withColumn("in", F.lit(1)), at, "left").groupBy(*keys).agg(F.count("*").alias("n_boundary"), F.count("in").alias("n_inside"))
    seen = observed.groupBy(*keys).agg(F.count("*").alias("n_observed"))
    out = grid.select(*keys).distinct().join(hit, keys, "left").join(seen, keys, "left").fillna(0, ["n_boundary", "n_inside", "n_observed"])
    share = F.when(F.col("n_boundary") > 0, F.col("n_inside") / F.col("n_boundary")).otherwise((F.col("n_observed") == 0).cast("double"))
    return out.select(*keys, "n_boundary", "n_inside", share.alias("coverage"))


def acquisition_study(cells: DataFrame, keys: list[str], arrival: str, start: str, end: str, samples: int = 50, steps: int = 10_000, seed: str = "acq") -> DataFrame:
    """Brier scores of the window's probability and of the state at its end, over sampled instants of acquisition.

    Every key gets `samples` instants, reproducible from seed; each cell is scored against all of its key's.
    """
    instants = cells.groupBy(*keys).agg(F.min(start).alias("_a"), F.max(end).alias("_b")).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    u = draw(F.concat_ws("/", *keys), F.col("sample"), F.lit(steps), seed) / float(steps)
    instants = instants.select(*keys, "sample", (F.col("_a") + (F.col("_b") - F.col("_a")) * u).alias("instant"))
    x = cells.join(instants, keys).withColumns({
        "truth": F.coalesce(F.col(arrival) <= F.col("instant"), F.lit(False)).cast("double"),
        "p": acquired_probability(F.col(arrival), F.col(start), F.col(end)),
        "last": F.coalesce(F.col(arrival) <= F.col(end), F.lit(False)).cast("double"),
    })
    square = lambda c: (F.col(c) - F.col("truth")) * (F.col(c) - F.col("truth"))
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(square("p")).alias("brier_window"), F.avg(square("last")).alias("brier_end"))
