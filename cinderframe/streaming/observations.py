"""Structured Streaming forms of delayed delivery, last-wins replacement, periodic windows and terminal states."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windows(stream: DataFrame, time: str, by: list[str], value: str, width: str, late: str) -> DataFrame:
    """Counts and sums per tumbling window and group; rows later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def coalesced(stream: DataFrame, time: str, by: list[str], flag: str, late: str, kept: list[str] | None = None) -> DataFrame:
    """Rows of equal group and time as one, with the flags' disjunction, their number, and `kept` columns of the least source
    (by these columns in order). In append mode a group is written once no row of its time can come, and its state is dropped."""
    first = F.min(F.struct(*kept)).alias("_k") if kept else F.lit(None).alias("_k")
    out = stream.withWatermark(time, late).groupBy(*by, time).agg(F.bool_or(flag).alias(flag), F.count("*").alias("n_sources"), first)
    return out.select(*by, time, flag, "n_sources", *[F.col(f"_k.{c}").alias(c) for c in kept or []])


def _deliver(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep observations until the watermark has passed the time at which they are available."""
    held = list(zip(*state.get, strict=True)) if state.exists else []
    for pdf in batches:
        held += [(int(s), int(a), float(v)) for s, a, v in zip(pdf["sensed_ms"], pdf["available_ms"], pdf["value"], strict=True)]
    now = state.getCurrentWatermarkMs()
    out = sorted((s, a, v) for s, a, v in held if a <= now)
    held = [x for x in held if x[1] > now]
    if held:
        state.update(tuple(list(c) for c in zip(*held, strict=True)))
        state.setTimeoutTimestamp(max(now + 1, min(x[1] for x in held)))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["sensed_ms", "available_ms", "value"]).assign(key=key[0])[["key", "sensed_ms", "available_ms", "value"]]


def delivered(stream: DataFrame, key: str, sensed: str, available: str, value: str, late: str) -> DataFrame:
    """Observations released in order of sensing once event time has reached their availability."""
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = stream.withColumn("_t", F.col(sensed).cast("timestamp")).withWatermark("_t", late).select(F.col(key).cast("string").alias("key"), "_t", ms(sensed).alias("sensed_ms"), ms(available).alias("available_ms"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(_deliver, "key string, sensed_ms long, available_ms long, value double", "sensed array<long>, available array<long>, value array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def _newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter("_r = 1").drop("_r")


def last_wins(path: str, keys: list[str], order: str | list[str], compact: int = 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch keeps its last row per key; `current` reads the last over all batches. order is total, so
    that of two rows of a key one is later.

    Every `compact`-th batch is written aside with the last rows over all so far and put into place by a rename; only
    then are the batches before it deleted. A batch that runs again replaces itself. If it is a compacting one that is
    in place already, it holds all that it should and stays; so a replay loses nothing, wherever the first run ended.
    """
    order = [order] if isinstance(order, str) else order

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = _newest(batch, keys, order)
        if not number or number % compact:
            newest.write.mode("overwrite").parquet(f"{path}/batch={number}")
            return
        at = spark._jvm.org.apache.hadoop.fs.Path
        files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(at(path))] if files.exists(at(path)) else []
        old = [f"{path}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < number]
        if f"batch={number}" not in names:
            if old:
                before = spark.read.option("basePath", path).schema(f"{newest._jdf.schema().toDDL()}, batch int").parquet(*old)
                newest = current(before.unionByName(newest.withColumn("batch", F.lit(number))), keys, order)
            newest.write.mode("overwrite").parquet(f"{path}/_compacting-{number}")
            if not files.rename(at(f"{path}/_compacting-{number}"), at(f"{path}/batch={number}")):
                raise OSError(f"{path}/batch={number} could not be put into place")
        for x in old:
            files.delete(at(x), True)

    return sink


def current(rows: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """The last row per key of a table that last_wins writes."""
    return _newest(rows, keys, [*([order] if isinstance(order, str) else order), "batch"]).drop("batch")


def _until_terminal(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An episode comes in parts, in any order: steps after the earliest terminal one so far go at once, others wait for the rest."""
    over = state.exists and state.get[0]
    held, stop, ended = [], None, over
    for pdf in batches:
        if over:
            continue
        ends = pdf.loc[pdf["terminal"].eq(True), "minute"]
        ended = ended or bool(len(ends))
        if ends.notna().any() and (stop is None or ends.min() < stop):
            stop = ends.min()
            held = [x[x["minute"] <= stop] for x in held]
        held.append(pdf if stop is None else pdf[pdf["minute"] <= stop])
    if held:
        yield pd.concat(held).sort_values("minute", kind="stable")
    state.update((bool(ended),))


def until_terminal(stream: DataFrame) -> DataFrame:
    """Steps (episode_id, minute, terminal) up to the minute of the first terminal one of each episode among what a trigger takes;
    input of later triggers is ignored."""
    return stream.select("episode_id", "minute", "terminal").groupBy("episode_id").applyInPandasWithState(_until_terminal, "episode_id string, minute long, terminal boolean", "ended boolean", "append", GroupStateTimeout.NoTimeout)
