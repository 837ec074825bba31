"""Streams that are fed out of order, stopped and replayed."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cinderframe.streaming import observations as ob
from cinderframe.streaming.schedule import scheduled, timed_state

KIND = "k string, id long, t timestamp"


def feed(spark, path, rows):
    spark.createDataFrame(rows, "k string, id long, m int").coalesce(1).select("k", "id", F.timestamp_seconds(F.col("m") * 60).alias("t")).write.mode("append").parquet(path)


def test_schedule_of_shuffled_files_with_a_restart(spark, tmp_path):
    """Rows come in shuffled files, the query is stopped between them: each is taken once, in the order of the batch answer."""
    rng = random.Random(2)
    rows = [("ab"[i % 2], i, rng.randrange(1, 300)) for i in range(60)]
    rng.shuffle(rows)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    tick = F.ceil(F.unix_millis("t") / 3_600_000) * 3_600_000

    def run():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src)
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        with timed_state(spark):
            scheduled(stream, "k", "t", "id", tick, "300 minutes").writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    feed(spark, src, rows[:20])
    feed(spark, src, rows[20:40])
    run()
    feed(spark, src, rows[40:])
    feed(spark, src, [("z", None, 10_000)])  # only moves time
    run()
    feed(spark, src, [("a", 99, 30)])  # later than is allowed: left out
    run()
    got = spark.read.parquet(out).collect()
    for k in "ab":
        want = [(i, max(-(-m // 60) * 60, 0)) for m, i in sorted((m, i) for key, i, m in rows if key == k)]
        mine = sorted((r for r in got if r.key == k and not r.late), key=lambda r: r.seq)
        assert [(r.id, r.tick_ms // 60_000) for r in mine] == want and [r.seq for r in mine] == list(range(1, len(want) + 1))
    assert not [r for r in got if r.id == 99]


def test_replayed_batches_lose_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    sink = ob.last_wins(out, ["k"], ["t", "v"], 2)
    batches = [spark.createDataFrame([("a", n, n), (f"k{n}", n, n), (f"k{n}", n, n + 1)], "k string, t int, v int") for n in range(5)]

    def now():
        return {r.k: (r.t, r.v) for r in ob.current(spark.read.parquet(out), ["k"], ["t", "v"]).collect()}

    for n, batch in enumerate(batches):
        for _ in range(3):  # each batch is replayed, compacting ones too
            sink(batch, n)
            assert now() == {"a": (n, n)} | {f"k{i}": (i, i + 1) for i in range(n + 1)}


def test_coalesced_rows_keep_properties_and_drop_state(spark, tmp_path):
    src = str(tmp_path / "in")
    for rows in ([("a", 1, 10), ("a", 2, 10), ("b", 3, 11)], [("a", 4, 200)], [("a", 5, 201)]):
        feed(spark, src, rows)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src).withColumn("bad", F.col("id") == 2)
    q = ob.coalesced(stream, "t", ["k"], "bad", "1 minute", ["id"]).writeStream.outputMode("append").format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.k, r.bad, r.n_sources, r.id) for r in spark.table("merged").collect()}
    assert {("a", True, 2, 1), ("b", False, 1, 3)} <= got <= {("a", True, 2, 1), ("b", False, 1, 3), ("a", False, 1, 4)}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
