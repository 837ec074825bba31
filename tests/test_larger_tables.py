"""Cases that appear in larger tables: poles of formulas, exact ranks, episodes in parts, equal means."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinderframe.functions import weather as wx
from cinderframe.operators import frames, profile, raster
from cinderframe.plans import source_queries
from cinderframe.sources import tables
from cinderframe.streaming import observations as ob, schedule


def test_vapour_at_the_pole_of_its_formula(spark):
    """A height at which the lapse rate meets the pole of the Magnus form, and one beyond it."""
    rows = [(-243.04, 50.0, 0.0), (-243.04, 0.0, 0.0), (20.0, 50.0, 0.0), (20.0, 50.0, 60_000.0)]
    df = spark.createDataFrame(rows, "c double, h double, m double")
    t, h = wx.downscaled(F.col("c"), F.col("h"), F.col("m"), F.lit(0.0))
    got = df.select(wx.saturation_vapour_pressure_pa(F.col("c")).alias("p"), t.alias("t"), h.alias("h")).collect()
    assert [r.h for r in got] == [100.0, 100.0, pytest.approx(50.0), pytest.approx(0.0, abs=1e-9)]
    assert got[0].p == 0.0 and got[3].t == -370.0


def test_percentiles_are_exact(spark):
    """More values than a sketch tells apart; a null group, nulls, and a group of nulls alone."""
    v = [float(i) for i in range(200_000)]
    random.Random(3).shuffle(v)
    rows = [("a", x) for x in v] + [(None, x) for x in v[:50_001]] + [("a", None), ("b", None), ("c", 4.0)]
    got = {r.k: r for r in profile.latency(spark.createDataFrame(rows, "k string, s double").repartition(7), ["k"], "s").collect()}
    small = sorted(v[:50_001])
    assert (got["a"].n, got["a"].p50, got["a"].p95, got["a"].p99) == (200_001, 99_999.0, 189_999.0, 197_999.0)
    assert [got[None].p50, got[None].p95, got[None].p99] == [small[25_000], small[47_500], small[49_500]]
    assert (got["b"].n, got["b"].p50, got["b"].per_second, got["c"].p50, got["c"].per_second) == (1, None, None, 4.0, 0.25)
    assert profile.latency(spark.createDataFrame(rows[:200_000], "k string, s double"), [], "s").first().p95 == 189_999.0


def test_terminal_step_in_a_later_part(spark, tmp_path):
    """An episode of several parts within one trigger, not in order of time."""
    rows = [("e", m, m in (10, 20, 40)) for m in reversed(range(50))] + [("f", m, False) for m in range(7)]
    spark.createDataFrame(rows, "episode_id string, minute long, terminal boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 4)
    try:
        src = spark.readStream.schema("episode_id string, minute long, terminal boolean").parquet(str(tmp_path / "in"))
        q = ob.until_terminal(src).writeStream.outputMode("append").format("memory").queryName("terminal_parts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(size, before)
    got = spark.table("terminal_parts").collect()
    assert sorted(r.minute for r in got if r.episode_id == "e") == list(range(11)) and sum(r.episode_id == "f" for r in got) == 7


def test_equal_means_take_the_smallest_factor(spark, tmp_path):
    """0.8 and 1.0 have equal mean losses, which sums of doubles set apart in any order; a supplier without quantities stays."""
    rows = [(0, q) for q in (25.0, 26.0, 41.0, None)] + [(1, q) for q in (8.0, 25.0, 33.0)] + [(3, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.l_suppkey: (r.factor, r.score) for r in source_queries.q_grid_search(spark, str(tmp_path)).collect()}
    assert (got[0], got[1], got[3][1]) == ((0.8, -5.666667), (0.8, -8.666667), None)

def test_distances_in_a_tall_grid(spark):
    """Gaps whose squares leave the integers, columns without a window that looks ahead, and both sides in one pass."""
    grid = spark.createDataFrame([("g", y, x) for y in (0, 50_000, 100_000) for x in (0, 1)], "k string, y int, x int")
    mask = grid.filter("y = 0 and x = 0")
    got = {(r.y, r.x): r.d for r in raster.distance(mask, grid, ["k"]).collect()}
    assert got == {(y, x): pytest.approx((y * y + x * x) ** 0.5) for y in (0, 50_000, 100_000) for x in (0, 1)}
    signed = {(r.y, r.x): r.d for r in raster.signed_distance(grid.filter("y > 0"), grid, ["k"]).collect()}
    assert signed == {(y, x): 50_000.0 if not y else -float(y) for y in (0, 50_000, 100_000) for x in (0, 1)}
    plan = raster.signed_distance(mask, grid, ["k"])._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan.lower()


@pytest.mark.parametrize("reach", [0.0, 1.5, 13 ** 0.5, 9.0])
def test_growth_within_reach(spark, reach):
    """By offsets and by distances alike: against all pairs."""
    rng = random.Random(8)
    cells = [(y, x, rng.random() < 0.05, rng.random() < 0.7) for y in range(30) for x in range(20)]
    grid = spark.createDataFrame([("g", *c) for c in cells], "k string, y int, x int, hot boolean, fuel boolean")
    got = sorted((r.y, r.x) for r in raster.isotropic_growth(grid.filter("hot"), grid, ["k"], reach, F.col("fuel")).collect())
    hot = [(y, x) for y, x, h, _ in cells if h]
    assert got == [(y, x) for y, x, h, fuel in cells if h or fuel and any(((y - a) ** 2 + (x - b) ** 2) ** 0.5 <= reach for a, b in hot)]

@pytest.mark.parametrize(("tile", "factor"), [(4, 2), (5, 16), (256, 16)])
def test_parts_across_tiles(spark, tile, factor):
    """Parts that wind through many tiles, of two keys and a null one, with negative places: against a flood fill."""
    rng = random.Random(5)
    snake = [(y, x) for y in range(-20, 21) for x in range(-20, 21) if y % 2 == 0 or x == (20 if y % 4 == 1 else -20)]
    cells = {"snake": snake, "dots": [(y, x) for y in range(60) for x in range(-9, 14) if rng.random() < 0.42], None: [(3, 3), (4, 4), (9, 9)], "one": [(7, 8)]}
    df = spark.createDataFrame([(k, y, x) for k, v in cells.items() for y, x in v], "k string, y int, x int")
    got = {(r.k, r.y, r.x): r.label for r in raster.component_labels(df, ["k"], tile, factor).collect()}
    want = {}
    for k, v in cells.items():
        left = set(v)
        while left:
            part, reached = set(), [left.pop()]
            while reached:
                y, x = reached.pop()
                part.add((y, x))
                new = {(y + a, x + b) for a, b in raster.EIGHT} & left
                left -= new
                reached += new
            want |= {(k, y, x): min(a * 2**31 + b for a, b in part) for y, x in part}
    assert got == want


def test_parts_of_nothing(spark):
    assert raster.component_labels(spark.createDataFrame([], "k string, y int, x int"), ["k"]).count() == 0


def test_parts_take_few_steps(spark, monkeypatch):
    """A part of 40 tiles in a row: no step for each, and none that depends on its shape."""
    frame, n = type(spark.range(0)), []
    was = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a: n.append(1) or was(self, *a))
    df = spark.range(40 * 256).select(F.col("id").cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("x"))
    assert raster.component_labels(df, []).select("label").distinct().count() == 1
    assert len(n) <= 6


def test_items_by_line_and_by_file(spark, tmp_path):
    """Documents one a line give what they give one a file, with line ends and nulls inside them."""
    docs = [f'{{"id": "i{k}", "properties": {{"name": "a\\nb{k}"}}, "assets": {{"main": {{"href": "x/{k}"}}, "more": {{"href": null}}}}}}' for k in range(5)]
    for k, doc in enumerate(docs):
        (tmp_path / "each").mkdir(exist_ok=True)
        (tmp_path / "each" / f"{k}.json").write_text(doc)
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "all.json").write_text("\n".join(docs) + "\n")
    plain = lambda df: sorted((r.item_id, r.properties["name"], r.asset, r.href or "") for r in df.collect())
    got = plain(tables.read_items(spark, str(tmp_path / "lines"), lines=True))
    assert got == plain(tables.read_items(spark, str(tmp_path / "each"))) and len(got) == 10 and got[0][:2] == ("i0", "a\nb0")


def test_items_make_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "scratch_folder", lambda spark, name: str(tmp_path / name))
    spark.range(300).selectExpr("id AS s_suppkey", "'n' AS s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    assert source_queries.q_item_assets(spark, str(tmp_path)).count() == 300
    assert sum(f.is_file() for f in (tmp_path / "items").rglob("*")) < 50


def test_equal_polygons_are_taken_once(spark, monkeypatch):
    """A hundred copies of two shapes that overlap: the area of the two, from the edges of the two alone."""
    shapes = [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], [(1.0, 1.0), (5.0, 1.0), (3.0, 4.0)]]
    one = spark.createDataFrame([("k", [{"x": x, "y": y} for x, y in s]) for s in shapes], "k string, p array<struct<x: double, y: double>>")
    edges, n = frames._edges, []
    monkeypatch.setattr(frames, "_edges", lambda polygons, *a: n.append(polygons.count()) or edges(polygons, *a))
    assert frames.union_area(one.crossJoin(spark.range(100).select()).repartition(3), ["k"], "p", 1.0).first().area == pytest.approx(8 + 6 - 8 / 3)
    assert n == [2]


def test_schedule_reads_and_writes_once_a_key():
    """Fifty ticks of one key, in parts and out of order: a state and a timer for the key, not for each tick."""
    calls, held, timers = [], [None], set()
    state = SimpleNamespace(get=lambda: calls.append("get") or held[0], update=lambda x: calls.append("put") or held.__setitem__(0, x))
    handle = SimpleNamespace(getValueState=lambda *a: state, registerTimer=lambda t: calls.append("timer") or timers.add(t), deleteTimer=lambda t: calls.append("timer") or timers.discard(t))
    at = lambda now: SimpleNamespace(getCurrentWatermarkInMs=lambda: now)
    part = lambda rows: pd.DataFrame(rows, columns=["tick_ms", "at_ms", "id"])
    p = schedule.Schedule()
    p.init(handle)
    rows = [(100 * (k % 50 + 1), k, 2**60 + k) for k in range(200)]
    random.Random(6).shuffle(rows)
    assert not list(p.handleInputRows(("a",), iter([part(rows[:90]), part([(7, 7, None)]), part(rows[90:])]), at(0)))
    assert calls == ["get", "put", "timer"] and timers == {100}
    early = [r for x in p.handleExpiredTimer(("a",), at(2000), SimpleNamespace(getExpiryTimeInMs=lambda: timers.pop())) for r in x.itertuples(index=False)]
    late = [r for x in p.handleInputRows(("a",), iter([part([(100, 1, 5)])]), at(2000)) for r in x.itertuples(index=False)]
    rest = [r for x in p.handleExpiredTimer(("a",), at(9000), SimpleNamespace(getExpiryTimeInMs=lambda: timers.pop())) for r in x.itertuples(index=False)]
    assert len(calls) <= 10 and not timers
    assert [(r.tick_ms, r.at_ms, r.id) for r in early + rest] == sorted(rows) and {r.tick_ms for r in early} == set(range(100, 2001, 100))
    assert [(r.id, r.late) for r in late] == [(5, True)] and [r.seq for r in early + late + rest] == list(range(1, 202)) and not any(r.late for r in early + rest)
