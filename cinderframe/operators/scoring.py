"""Scores of probability forecasts and of predicted areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def edges(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def bin_of(p: Column, bins: int) -> Column:
    """The bin of p by comparison with the edges; the last bin is closed."""
    return F.least(F.lit(bins - 1), sum((F.when(p >= e, 1).otherwise(0) for e in edges(bins)[1:-1]), F.lit(0)))


def reliability(rows: DataFrame, by: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Per bin: n, mean probability and observed frequency."""
    x = rows.select(*by, clipped(F.col(p)).alias("p"), F.col(y).cast("double").alias("y")).withColumn("bin", bin_of(F.col("p"), bins))
    return x.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("freq"))


def proper_scores(rows: DataFrame, by: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Brier score, whole and of events and non-events and their mean, log score, expected calibration error, and the
    forecasts' mean variance p (1 - p)."""
    x = rows.select(*by, clipped(F.col(p)).alias("p"), F.col(y).cast("double").alias("y"))
    sq = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    log = -(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))
    event = F.avg(F.when(F.col("y") == 1, sq))
    other = F.avg(F.when(F.col("y") == 0, sq))
    out = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg(sq).alias("brier"), event.alias("brier_event"), other.alias("brier_other"), F.avg(log).alias("log_score"), F.avg(F.col("p") * (1 - F.col("p"))).alias("variance"))
    table = reliability(rows, by, p, y, bins)
    ece = table.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("freq"))) / F.sum("n")).alias("ece"))
    out = out.join(ece, by) if by else out.crossJoin(ece)  # one row each
    return out.withColumn("brier_balanced", (F.col("brier_event") + F.col("brier_other")) / 2)


def weighted_scores(rows: DataFrame, by: list[str], p: str, y: str, weight: str) -> DataFrame:
    """Weighted Bernoulli log-likelihood and Brier score."""
    p_, y_, w = clipped(F.col(p)), F.col(y).cast("double"), F.col(weight)
    ll = y_ * F.log(p_) + (1 - y_) * F.log(1 - p_)
    return rows.groupBy(*by).agg((F.sum(w * ll) / F.sum(w)).alias("log_likelihood"), (F.sum(w * (p_ - y_) * (p_ - y_)) / F.sum(w)).alias("brier"))


def soft_overlap(rows: DataFrame, by: list[str], p: str, q: str) -> DataFrame:
    """Sum of minima over sum of maxima of two soft occupancies, and their mean squared difference."""
    a, b = F.col(p), F.col(q)
    return rows.groupBy(*by).agg((F.sum(F.least(a, b)) / F.greatest(F.sum(F.greatest(a, b)), F.lit(1e-12))).alias("soft_iou"), F.avg((a - b) * (a - b)).alias("soft_brier"))


def censored_loss(rows: DataFrame, by: list[str], arrival: str, low: str, high: str) -> DataFrame:
    """Mean distance of an arrival from the interval in which it was seen; without an upper end only too early counts."""
    t, a, b = F.col(arrival), F.col(low), F.col(high)
    loss = F.when(t < a, a - t).when(b.isNotNull() & (t > b), t - b).otherwise(0.0)
    return rows.groupBy(*by).agg(F.avg(F.when(b.isNotNull(), loss)).alias("loss_seen"), F.avg(F.when(b.isNull(), loss)).alias("loss_open"))


def confusion(predicted: DataFrame, observed: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Overlap of two sets of cells (keys, y, x): iou, precision, recall and areas."""
    both = predicted.select(*keys, "y", "x", F.lit(1).alias("p")).join(observed.select(*keys, "y", "x", F.lit(1).alias("o")), [*keys, "y", "x"], "full")
    out = both.groupBy(*keys).agg(F.count_if(F.col("p").isNotNull() & F.col("o").isNotNull()).alias("hit"), F.count("p").alias("n_p"), F.count("o").alias("n_o"), F.count("*").alias("either"))
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    km2 = cell * cell / 1e6
    return out.select(*keys, per("hit", "either").alias("iou"), per("hit", "n_p").alias("precision"), per("hit", "n_o").alias("recall"), ((F.col("n_p") - F.col("n_o")) * km2).alias("area_bias_km2"), (F.col("either") - F.col("hit")).alias("difference"))
