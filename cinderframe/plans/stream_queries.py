"""Streaming operators run to the end of the event table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cinderframe.streaming import observations as ob
from cinderframe.streaming.schedule import scheduled, timed_state


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where that is unset in local mode, in a temporary one."""
    conf = spark.sparkContext.getConf()
    shared = conf.get("spark.checkpoint.dir")
    if not shared and not (conf.get("spark.master") or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/') if shared else tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark: SparkSession, stream: DataFrame, folder: str, time: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run a stream to its end, then once more from its checkpoint with one empty row of a far later time, which lets event time
    pass everything that still waits."""
    beats = f"{folder}/beats"
    at = spark._jvm.org.apache.hadoop.fs.Path(beats)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(beats))
    start(both).awaitTermination()
    empty = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != time else F.lit("2200-01-01 00:00:00").cast("timestamp").alias(time) for f in stream.schema]
    spark.range(1).select(*empty).write.mode("append").parquet(beats)
    start(both).awaitTermination()


def _append(out: DataFrame, folder: str) -> StreamingQuery:
    """Start a query that writes what each batch adds to a folder of its own; a batch that runs again replaces it."""
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    return out.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows of the event stream, each written once event time has passed it."""
    folder = scratch_folder(spark, "stream")
    _drained(spark, _stream(spark, d), folder, "ts", lambda x: _append(ob.windows(x, "ts", ["event_type"], "value", "1 day", "1 hour"), folder))
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def q_stream_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of every user and kind after the stream has been merged batch by batch."""
    folder = scratch_folder(spark, "stream")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    query = _stream(spark, d).writeStream.foreachBatch(ob.last_wins(f"{folder}/out", keys, order)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return ob.current(spark.read.parquet(f"{folder}/out"), keys, order).select("user_id", "event_type", "event_id", "value")


def q_stream_coalesced(spark: SparkSession, d: str) -> DataFrame:
    """Events of one user and hour as one, with whether any of them is an error; an hour's state goes when it is written."""
    folder = scratch_folder(spark, "stream")
    hours = _stream(spark, d).withColumn("hour", F.date_trunc("hour", "ts")).withColumn("bad", F.col("event_type") == "error")
    _drained(spark, hours, folder, "hour", lambda x: _append(ob.coalesced(x, "hour", ["user_id"], "bad", "1 day"), folder))
    return spark.read.parquet(f"{folder}/out").filter("user_id is not null").select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "bad", "n_sources")


def q_stream_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Observations taken by a stream at the tick of their schedule: those of each tick, the last one, and all so far."""
    folder = scratch_folder(spark, "stream")
    clicks = _stream(spark, d).filter("event_type = 'click' or event_type is null")
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    clicks = clicks.withColumn("minute", minute).withColumn("tick", F.ceil((F.col("minute") + F.get_json_object("props", "$.k").cast("int")) / 720) * 720)
    clicks = clicks.select("user_id", "event_id", F.timestamp_seconds(F.col("minute") * 60).alias("at"), "tick")
    with timed_state(spark):
        _drained(spark, clicks, folder, "at", lambda x: _append(scheduled(x, "user_id", "at", "event_id", F.coalesce(F.col("tick"), F.lit(1 << 40)) * 60_000, "1 hour"), folder))
    out = spark.read.parquet(f"{folder}/out").filter("key is not null")
    return out.groupBy(F.col("key").alias("user_id"), (F.col("tick_ms") / 60_000).cast("long").alias("tick")).agg(F.count("*").alias("n"), F.max_by("id", "seq").alias("last"), F.max("seq").alias("n_so_far"), F.count_if("late").alias("late"))


QUERIES = {f.__name__: f for f in (q_stream_windows, q_stream_last_wins, q_stream_coalesced, q_stream_schedule)}
SQL = {
    "q_stream_schedule": """
WITH x AS (SELECT user_id, event_id, epoch_us(ts) // 60000000 AS t0, CAST(ceil((epoch_us(ts) // 60000000 + CAST(props->>'k' AS INT)) / 720.0::DOUBLE) AS BIGINT) * 720 AS tick FROM events WHERE event_type = 'click'),
g AS (SELECT user_id, tick, count(*) AS n, arg_max(event_id, (t0, event_id)) AS last FROM x GROUP BY user_id, tick)
SELECT user_id, tick, n, last, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY tick) AS BIGINT) AS n_so_far, 0::BIGINT AS late FROM g
""",
    "q_stream_coalesced": "SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS hour, bool_or(event_type = 'error') AS bad, count(*) AS n_sources FROM events GROUP BY ALL",
    "q_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "q_stream_last_wins": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
}
