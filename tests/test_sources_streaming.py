import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderframe.operators import audit
from cinderframe.sources import tables
from cinderframe.streaming import observations as ob


def test_landscape_cells(spark, tmp_path):
    base = {c: np.arange(12, dtype=np.float32).reshape(3, 4) for c in ("elevation_m", "fuel_load_kg_m2", "asset_value")}
    np.savez(tmp_path / "a.npz", barrier=np.zeros((3, 4), bool), **base)
    cells = tables.read_landscapes(spark, str(tmp_path))
    assert cells.count() == 12 and cells.filter("y = 2 and x = 1").first().elevation_m == 9 and cells.filter("canopy_cover is not null").count() == 0
    assert {r.n_broken for r in audit.violations(cells, ["path"], tables.landscape_rules()).collect()} == {0}


def test_features_and_hours(spark, tmp_path):
    ring = [[[-121.0, 39.0], [-120.9, 39.0], [-120.9, 39.1], [-121.0, 39.0]]]
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"t": 1}, "geometry": {"type": "Polygon", "coordinates": ring}}]}))
    f = tables.read_features(spark, str(tmp_path / "p.json")).select(F.col("properties")["t"].alias("t"), tables.bounding_box(F.col("geometry")).alias("b")).first()
    assert f.t == "1" and f.b == [-121.0, 39.0, -120.9, 39.1]
    (tmp_path / "h.json").write_text(json.dumps({"a": {"2022070102": 1.0, "2022070103": -999.0, "2022070104": 3.0}, "b": {"2022070102": 5.0, "2022070103": 2.0}}))
    assert [(r.hour, r.a, r.b) for r in tables.read_hourly(spark, str(tmp_path / "h.json"), ["a", "b"]).collect()] == [("2022070102", 1.0, 5.0)]


def test_catalog_rejects_a_repeated_key():
    with pytest.raises(ValueError, match="occur twice: a"):
        tables.read_catalog('{"b": 1, "a": 1, "a": 2}')


def test_events_and_resumption(spark, tmp_path):
    rows = spark.createDataFrame([("e", 1, "drop", 5.0), ("e", 2, "hold", None)], "episode_id string, minute int, kind string, litres double")
    tables.write_events(rows, str(tmp_path / "log"), ["litres"])
    back = tables.read_events(spark, str(tmp_path / "log"), "litres double")
    assert sorted((r.minute, r.kind, r.payload.litres) for r in back.collect()) == [(1, "drop", 5.0), (2, "hold", None)]
    for n in (3, 5):
        tables.write_missing(spark.range(n), str(tmp_path / "t"), ["id"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 1, 2, 3, 4]


def run(spark, stream, path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(path.name.replace("-", "_")).option("checkpointLocation", str(path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(path.name.replace("-", "_")).collect()


def test_terminal_state_absorbs(spark, tmp_path):
    for k, rows in enumerate([[("e", 1, False), ("e", 2, True), ("e", 3, False)], [("e", 4, False), ("f", 1, False)]]):
        spark.createDataFrame(rows, "episode_id string, minute long, terminal boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("episode_id string, minute long, terminal boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, ob.until_terminal(src), tmp_path)
    assert ("e", 3) not in {(r.episode_id, r.minute) for r in got} and ("f", 1) in {(r.episode_id, r.minute) for r in got}


def test_delayed_observations_wait(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "2024-01-01 02:00:00", 1.0), ("a", "2024-01-01 00:30:00", "2024-01-01 00:40:00", 2.0), ("b", "2024-01-01 01:00:00", "2024-01-01 09:00:00", 3.0)]
    for part in (rows, [("z", "2024-01-01 03:00:00", "2024-01-01 03:00:00", 0.0)], [("z", "2024-01-01 03:01:00", "2024-01-01 03:01:00", 0.0)]):
        spark.createDataFrame(part, "k string, s string, a string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k string, s string, a string, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    src = src.select("k", F.to_timestamp("s").alias("s"), F.to_timestamp("a").alias("a"), "v")
    got = [(r.key, r.value) for r in run(spark, ob.delivered(src, "k", "s", "a", "v", "0 seconds"), tmp_path)]
    assert ("b", 3.0) not in got and {("a", 1.0), ("a", 2.0)} <= set(got)


def test_last_wins_compacts(spark, tmp_path):
    """Five batches, compacted at every second: the same last rows, and only few batches left."""
    for k in range(5):
        spark.createDataFrame([("a", k, 10 * k), (f"k{k}", k, k)], "k string, t int, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k string, t int, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    src.writeStream.foreachBatch(ob.last_wins(out, ["k"], "t", 2)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.k: r.v for r in ob.current(spark.read.parquet(out), ["k"], "t").collect()}
    assert got == {"a": 40, "k0": 0, "k1": 1, "k2": 2, "k3": 3, "k4": 4}
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.name.startswith("batch=")) == ["batch=4"]
