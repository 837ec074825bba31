"""Ranked and stratified selection, capacity and assignment."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.operators.statistics import quantiles


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order (give a total order)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def round_robin(rows: DataFrame, strata: list[str], order: list[str], n: int) -> DataFrame:
    """n rows: the first of each stratum, then the second of each, and so on; strata in order."""
    ranked = rows.withColumn("round", F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))
    return ranked.filter(F.col("round") <= n).orderBy("round", *strata).limit(n)


def quartile(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """rows with `quartile` (0 to 3) of value inside its group."""
    q = quantiles(rows, by, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    return rows.join(q, by).withColumn("quartile", sum((F.when(F.col(value) > F.col(f"_q{i}"), 1).otherwise(0) for i in (1, 2, 3)), F.lit(0))).drop("_q1", "_q2", "_q3")


def systematic(n_frames: Column, wanted: int) -> Column:
    """Distinct frame numbers, `wanted` of them evenly from the first to the last."""
    steps = F.sequence(F.lit(0), F.lit(wanted - 1))
    return F.array_distinct(F.transform(steps, lambda i: F.floor(i * (n_frames - 1) / F.lit(float(max(1, wanted - 1)))).cast("long")))


def capacity_rank(rows: DataFrame, keys: list[str], order: list[str], capacity: Column) -> DataFrame:
    """rows with `rank` in their group and whether it is within the capacity."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).withColumn("accepted", F.col("rank") <= capacity)


def admit(queue: DataFrame, site: list[str], age: str, index: str, bays: str) -> DataFrame:
    """The rows that free bays admit: the oldest first, of equals the lowest index."""
    return capacity_rank(queue, site, [F.desc(age), index], F.col(bays)).filter("accepted").drop("rank", "accepted")


def nearest_feasible(pairs: DataFrame, resource: list[str], distance: str, task: str, ok: Column) -> DataFrame:
    """Each resource's nearest feasible task, of equals the lowest; null where none is feasible."""
    return pairs.groupBy(*resource).agg(F.min(F.when(ok, F.struct(F.col(distance).alias("d"), F.col(task).alias("t")))).alias("m")).select(*resource, F.col("m.t").alias(task), F.col("m.d").alias(distance))


def greedy_matching(pairs: DataFrame, case: list[str], resource: str, task: str, value: str) -> DataFrame:
    """One decision per case: resources in order take the task of greatest value that is left.

    The order matters, so a case is folded in its group: an array of (resource, task, value) in the order in
    which resources choose. A case is one decision (its resources times its tasks), not the table.
    """
    x = pairs.groupBy(*case).agg(F.array_sort(F.collect_list(F.struct(F.col(resource).alias("r"), (-F.col(value)).alias("v"), F.col(task).alias("t")))).alias("x"))
    kind = x.selectExpr("slice(x, 1, 0) as e").schema["e"].dataType
    def step(acc: Column, p: Column) -> Column:
        free = ~F.exists(acc, lambda q: (q.r == p.r) | (q.t == p.t))
        return F.when(free, F.concat(acc, F.array(p))).otherwise(acc)

    taken = x.select(*case, F.explode(F.aggregate("x", F.array().cast(kind), step)).alias("p"))
    return taken.select(*case, F.col("p.r").alias(resource), F.col("p.t").alias(task), (-F.col("p.v")).alias(value))


def _best(resource: str, task: str, value: str, capacity: str | None, case: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of greatest total value, resource by resource over what is left of the tasks' capacities; of equal totals
        the picks that come first in order."""
        room = pdf.groupby(task)[capacity].max().astype(int) if capacity else pdf.groupby(task)[task].size() * 0 + 1
        tasks = list(room.index)
        at = {t: i for i, t in enumerate(tasks)}
        best: dict[tuple, tuple[float, tuple]] = {tuple(room): (0.0, ())}
        for r, own in pdf.sort_values([resource, task]).groupby(resource, sort=True):
            step = dict(best)
            for left, (total, picks) in best.items():
                for t, v in zip(own[task], own[value], strict=True):
                    if left[at[t]] > 0:
                        state = tuple(n - (i == at[t]) for i, n in enumerate(left))
                        new = (round(total + v, 9), (*picks, (r, t, v)))
                        old = step.get(state)
                        if old is None or (-new[0], new[1]) < (-old[0], old[1]):
                            step[state] = new
            best = step
        picks = min(best.values(), key=lambda x: (-x[0], x[1]))[1]
        out = pd.DataFrame(picks, columns=[resource, task, value])
        for c in reversed(case):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    return run


def best_matching(pairs: DataFrame, case: list[str], resource: str, task: str, value: str, capacity: str | None = None) -> DataFrame:
    """The assignment of greatest total value in each case: a resource takes one task at most, a task as many resources as
    its capacity (one without the column). Of equal totals, the picks first in order of resource and task.

    A case is one decision, with at most some twenty tasks: the search goes over what is left of their capacities.
    """
    kinds = pairs.select(*case, resource, task, F.col(value).cast("double").alias(value), *([capacity] if capacity else []))
    out = kinds.drop(capacity) if capacity else kinds
    return kinds.groupBy(*case).applyInPandas(_best(resource, task, value, capacity, case), out.schema)
