"""Service at sites, action rules, registries, grids, labels and stretches on small rows."""

import json
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cinderframe.functions import geo
from cinderframe.operators import fleet, service as sv
from cinderframe.sources import tables


def test_running_sums_of_a_hot_key(spark):
    """One key holds nearly all rows, over many chunks, with ties of order broken by id and nulls among values."""
    rng = np.random.default_rng(4)
    rows = [(0 if i % 50 else int(i % 7), int(rng.integers(0, 2000)), i, None if i % 13 == 0 else int(rng.integers(0, 9))) for i in range(3000)]
    got = sv.running_before(spark.createDataFrame(rows, "k int, t int, id int, v int"), ["k"], F.floor(F.col("t") / 40), ["t", "id"], "v", "before").collect()
    want, total = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = total.get(k, 0)
        total[k] = want[i] + (v or 0)
    assert {r.id: r.before for r in got} == want and set(got[0].asDict()) == {"k", "t", "id", "v", "before"}


def test_service_by_hand_and_by_loop(spark):
    rng = np.random.default_rng(8)
    sites = [(s, 1 + s % 3, 40.0 + 30 * s, 100 * (s % 2), 900 + 50 * s, 4, 2.0) for s in range(5)]
    queue = [(i, int(rng.integers(0, 6)), int(rng.integers(0, 20)) * 60, int(rng.integers(0, 4)), float(rng.integers(0, 12)), "water" if i % 4 else "crew") for i in range(600)]
    got = sv.served(
        spark.createDataFrame(queue, "id int, site int, minute int, age int, missing double, kind string"),
        spark.createDataFrame(sites, "site int, bays int, stock double, open_minute int, close_minute int, fixed_minutes int, rate double"),
        "site", "minute", "age", ["id"], "missing", F.col("kind") == "water", chunk=300.0,
    ).collect()
    left = {s[0]: s[2] for s in sites}
    spec = {s[0]: s for s in sites}
    want = {}
    for minute in range(0, 1200, 60):
        for s in spec:
            if not spec[s][3] <= minute < spec[s][4]:
                continue
            waiting = sorted((q for q in queue if q[1] == s and q[2] == minute), key=lambda q: (-q[3], q[0]))
            for q in waiting[: spec[s][1]]:
                load = min(q[4], left[s]) if q[5] == "water" else 0.0
                left[s] -= load
                want[q[0]] = (load, left[s], max(1, math.ceil(4 + load / 2.0)))
    assert {r.id: (r.load, r.stock_left, r.minutes) for r in got} == want
    assert any(w[1] == 0 for w in want.values()) and len(want) > 50


def test_each_rule_is_broken_alone(spark):
    """A visit that breaks nothing, and for every rule one change that breaks it and nothing else; holding breaks nothing."""
    fine = dict(task="service", kind="water", status="available", payload=0.5, flown=10.0, latency=1, modes=["dip"], max_wind=9.0, max_intensity=5.0, depth=1.0, length=50.0, mode="dip", services=["water", "fuel"], bays=1, open=0, close=100, s_wind=9.0, s_depth=1.0, s_length=50.0, stock=1.0, minute=10, travel=5.5, wind=8.0, intensity=1.0, reserve=True)
    changes = {"kind": dict(status="returning"), "mode": dict(modes=["ramp"]), "use": dict(payload=1.0, flown=0.0), "bays": dict(bays=0), "hours": dict(close=17), "site_wind": dict(s_wind=7.0), "depth": dict(s_depth=0.5), "length": dict(s_length=10.0), "stock": dict(stock=0.0), "payload": dict(task="water", payload=0.1), "wind": dict(max_wind=7.0), "intensity": dict(task="line", kind="crew", intensity=6.0), "reserve": dict(reserve=False)}
    rows = [{"name": "none", **fine}, *({"name": k, **fine, **v} for k, v in changes.items()), {"name": "hold", **fine, "task": "hold", "reserve": False, "status": "returning"}, {"name": "no site", **fine, **dict.fromkeys(("mode", "services", "bays", "open", "close", "s_wind", "s_depth", "s_length", "stock"))}, {"name": "elsewhere", **fine, "task": "water", **dict.fromkeys(("mode", "services", "bays", "open", "close", "s_wind", "s_depth", "s_length", "stock"))}]
    kinds = "name string, task string, kind string, status string, payload double, flown double, latency int, modes array<string>, max_wind double, max_intensity double, depth double, length double, mode string, services array<string>, bays int, open int, close int, s_wind double, s_depth double, s_length double, stock double, minute int, travel double, wind double, intensity double, reserve boolean"
    x, c = spark.createDataFrame(rows, kinds), F.col
    resource = {k: c(k) for k in ("payload", "flown", "latency", "modes", "max_wind", "max_intensity", "depth", "length")}
    site = {k: c(k) for k in ("mode", "services", "bays", "open", "close", "stock")} | {"max_wind": c("s_wind"), "depth": c("s_depth"), "length": c("s_length")}
    rules = sv.action_rules(c("task"), c("kind"), c("status"), resource, site, c("minute"), c("travel"), c("wind"), c("intensity"), c("reserve"), 0.2, 20.0, 20.0)
    got = {r.name: (r.broken, r.feasible) for r in fleet.feasible(x, rules).collect()}
    assert set(changes) == set(rules)
    assert {k: got[k] for k in changes} == {k: ([k], False) for k in changes}
    assert got["none"] == got["hold"] == got["elsewhere"] == ([], True)
    assert not got["no site"][1] and len(got["no site"][0]) == 8


def _registry(name, docs, profiles, version=1):
    return json.dumps({"schema_version": version, "registry_id": name, "researched_at": "2024", "documents": [{"document_id": x} for x in docs], "profiles": [{"profile_id": p, "domains": d} for p, d in profiles]})


def test_registries_and_their_faults(spark, tmp_path):
    cite = lambda *x: {"status": "closed", "document_ids": list(x)}
    (tmp_path / "a.json").write_text(_registry("a", ["d1", "d2"], [("p1", {"range": cite("d1"), "payload": cite()}), ("p2", {"range": cite("d2")})]))
    (tmp_path / "b.json").write_text(_registry("b", ["d1", "d1"], [("p1", {"range": cite("d1", "d9")}), ("p1", {"range": cite("d9")}), ("p3", {})]))
    documents, evidence = tables.read_registries(spark, str(tmp_path))
    assert documents.count() == 4 and evidence.count() == 5
    known = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p2"), ("b", "p3")], "registry_id string, profile_id string")
    got = sorted(tuple(r) for r in sv.registry_faults(documents, evidence, known).collect())
    assert got == [("b", "document twice", "d1"), ("b", "no evidence", "p2"), ("b", "no evidence", "p3"), ("b", "profile twice", "p1"), ("b", "unknown document", "d9"), ("b", "unknown profile", "p1")]
    (tmp_path / "c.json").write_text(_registry("c", [], [], version=2))
    with pytest.raises(PySparkException, match="unsupported version"):
        tables.read_registries(spark, str(tmp_path))[0].collect()


def test_grids_rates_and_labels(spark):
    rows = [(3857, 60.0), (32633, 60.0), (4326, 60.0), (None, 60.0), (5070, None), (3857, None)]
    got = [r.m for r in spark.createDataFrame(rows, "e int, lat double").select(geo.metric_suitability(F.col("e"), F.col("lat")).alias("m")).collect()]
    assert [(m.web_mercator, m.metric, m.reason is None) for m in got] == [(True, False, False), (False, True, True), (False, False, False), (False, False, False), (False, True, True), (True, False, False)]
    assert got[0].scale == pytest.approx(0.5) and got[0].area_scale == pytest.approx(0.25) and got[1].scale is None and got[5].scale is None
    rows = [(4, 9, 10.0, 100.0), (9, 4, 10.0, 0.0), (4, 9, 0.0, None), (None, 9, 1.0, None)]
    got = spark.createDataFrame(rows, "a int, b int, m double, want double").select(geo.radius_rate(F.col("a"), F.col("b"), F.col("m"), 1000 * math.sqrt(math.pi)).alias("r"), "want").collect()
    assert [r.r if r.r is None else round(r.r, 9) for r in got] == [r.want for r in got]
    rows = [("2024-02-28T23:30:00Z", 45), (None, 7), (None, 99), (None, 1234), (None, -5)]
    got = spark.createDataFrame(rows, "t string, m int").select(geo.clock_label(F.col("t").cast("timestamp"), F.col("m")).alias("x")).collect()
    assert [r.x.replace("Z", "+00:00") for r in got] == ["2024-02-29T00:15+00:00", "T+007 min", "T+099 min", "T+1234 min", "T+-5 min"]


def test_stretch_of_odd_groups(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=500)
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [("flat", 1000, 3.0), ("flat", 1001, 3.0), (None, 1002, 1.0), (None, 1003, 2.0), ("none", 1004, None), ("a", 1005, float("nan"))]
    got = {r.id: r.b for r in sv.stretched(spark.createDataFrame(rows, "g string, id int, v double"), ["g"], "v", "b", gamma=2.0).collect()}
    lo, hi = np.percentile(v, [2, 98])
    want = np.sqrt(np.clip((v - lo) / (hi - lo), 0, 1))
    assert np.allclose([got[i] for i in range(500)], want) and len(got) == len(rows)
    assert got[1000] == got[1001] == 0.0 and (got[1002], got[1003]) == (0.0, 1.0) and got[1004] is None and got[1005] is None
