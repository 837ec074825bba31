"""Operators that cut hot groups into parts: the parts must give what the whole gives."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cinderframe.operators import analysis, fleet, frames, fuel, profile, raster, spatial, statistics as st, surfaces, timeseries as ts
from cinderframe.sources import manifest, tables


# quantiles, numbering, bootstrap


@pytest.mark.parametrize("most", [2, 5, 100_000])
def test_quantiles_by_ranges(spark, most):
    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 1)) for _ in range(400)] + [("b", float(rng.randrange(4))) for _ in range(300)] + [(None, 2.0 ** k) for k in range(40)] + [("c", 7.0)] * 50 + [("d", -1e308), ("d", 1e308), ("d", 0.0), ("e", None), ("a", None), ("a", math.nan)]
    shares = {"q10": 0.1, "q50": 0.5, "q99": 0.99, "q0": 0.0, "q100": 1.0}
    got = {r.k: r for r in st.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares, most, 4).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for k in got:
        v = [x for g, x in rows if g == k and x is not None and x == x]
        assert [got[k][c] for c in shares] == pytest.approx([np.quantile(v, p) for p in shares.values()] if k != "d" else [-8e307, 0.0, 9.8e307, -1e308, 1e308], rel=1e-12)
    one = st.quantiles(spark.createDataFrame(rows[:400], "k string, v double"), [], "v", {"m": 0.5}, most).first()
    assert one.m == pytest.approx(np.median([v for _, v in rows[:400]]))
    assert st.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", shares).count() == 0


def test_numbering_by_ranges(spark):
    rows = [("a" if i % 3 else None, (i * 7919) % 5003) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    assert sorted(r.number for r in st.numbered(df, "v").collect()) == list(range(2000))
    got = st.numbered(df, ["v"], ["k"]).collect()
    for k in ("a", None):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.v)
        assert [r.number for r in mine] == list(range(len(mine)))


def test_bootstrap_by_blocks(spark):
    """Replicates' means vary about the mean as they must, whatever the block; a mean of equal values is that value."""
    values = np.random.default_rng(2).normal(10, 3, 500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    for block in (16, 4096):
        means = [r["mean"] for r in st.bootstrap(df, "v", "i", 300, 5, block).collect()]
        assert len(means) == 300 and abs(np.mean(means) - values.mean()) < 0.03 and 0.8 < np.std(means) / (values.std() / math.sqrt(500)) < 1.2
    assert {r["mean"] for r in st.bootstrap(df.withColumn("v", F.lit(4.0)), "v", "i", 5).collect()} == {4.0}


# chunks of time


def series(n, seed):
    rng = random.Random(seed)
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([1, 5, 60, 400])
        out.append(("k", t, rng.uniform(-5, 40), rng.uniform(0, 100), rng.choice([0.0, 0.0, 0.0, 3.0])))
    return out


@pytest.mark.parametrize("chunk", [50.0, 1000.0, 1e9])
def test_moisture_of_one_hot_key_in_chunks(spark, chunk):
    rows = series(300, 3)
    df = spark.createDataFrame(rows, "k string, t long, c double, h double, r double")
    got = {r.t: r.moisture for r in fuel.dead_moisture(df, ["k"], "t", "c", "h", "r", 10.0, chunk=chunk).collect()}

    def equilibria(c, h):
        heat = 0.18 * (21.1 - c) * (1 - math.exp(-0.115 * h))
        x = [a * h**b + k * math.exp(0.1 * h) + heat for a, b, k in ((0.942, 0.679, 0.4994e-4), (0.618, 0.753, 0.4540e-4))]
        return min(3.0, max(0.0, max(x) * 0.01)), min(3.0, max(0.0, min(x) * 0.01))

    m = None
    for before, now in zip([None, *rows], rows):
        if before is None:
            m = sum(equilibria(now[2], now[3])) / 2
        else:
            c, h, r = ((before[i] + now[i]) / 2 for i in (2, 3, 4))
            up, low = equilibria(c, h)
            wet = max(r - 0.05, 0)
            rate = (1 - math.exp(-wet / 8)) / 8400 if wet else 1 / 600
            to = 2.5 if wet else max(min(m, up), low)
            m = min(3.0, max(0.0, m + (to - m) * -math.expm1(-(now[1] - before[1]) * rate)))
        assert got[now[1]] == pytest.approx(m, abs=1e-10)


def test_maps_of_many_steps_stay_short():
    """Points of a chunk's map: where steps pull hard, all moistures become one and the map two points."""
    n = 5000
    rng = np.random.default_rng(1)
    up, low = rng.uniform(0.1, 0.3, n), rng.uniform(0.0, 0.1, n)
    x, y = fuel._chunk_map(up, low, np.full(n, np.nan), np.full(n, 0.9))
    assert len(x) < 50


@pytest.mark.parametrize("chunk", [3.0, 40.0, 1e9])
def test_runs_across_chunks(spark, chunk):
    rng = random.Random(8)
    rows, want = [], {}
    for k in "abcd":
        t, times = 0, []
        for i in range(60):
            t += rng.choice([0, 1, 6, 7, 8, 20])
            times.append(t)
            rows.append((k, t, i))
        best, run, first = (0, None), 0, None
        for i in range(1, 60):
            if 5 <= times[i] - times[i - 1] <= 10:
                run, first = run + 1, first if run else i + 1
                if run > best[0]:
                    best = (run, first)
            else:
                run = 0
        want[k] = best
    got = ts.longest_run(spark.createDataFrame(rows, "k string, t long, i long"), ["k"], "t", "i", 5.0, 10.0, chunk).collect()
    assert {r.k: (r.run, r.start) for r in got} == want


def test_rows_beside_across_chunks(spark):
    rows = [("a", t, i) for t, i in [(0, 1), (0, 2), (99, 3), (100, 4), (900, 5)]] + [("b", 7, 6)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    got = {r.i: r._prev and r._prev.i for r in ts.lagged(df, ["k"], "t", ["i"], ["i"], 100.0).collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: 3, 5: 4, 6: None}
    got = {r.i: r._next and r._next.i for r in ts.lagged(df, ["k"], "t", ["i"], ["i"], 100.0, ahead=True).collect()}
    assert got == {1: 2, 2: 3, 3: 4, 4: 5, 5: None, 6: None}


# forcing analysis


def weather_case():
    rng = np.random.default_rng(6)
    cells = [("g", t, y, x, 3.0 + y / 10, float((40 * x + t) % 360), 15.0 + x, 40.0 + y) for t in (0, 60) for y in range(20) for x in range(20)]
    stations = [("g", int(rng.integers(0, 100)), float(rng.uniform(-1, 21)), float(rng.uniform(0, 19)), 4.0, float(rng.uniform(0, 360)), 18.0 if i % 3 else None, 90.0 if i % 4 else None) for i in range(30)]
    return cells, stations


def analysed(spark, cells, stations, **settings):
    names = "incident string, minute int, y {0}, x {0}, speed double, direction double, celsius double, humidity double"
    b, s = spark.createDataFrame(cells, names.format("int")), spark.createDataFrame(stations, names.format("double"))
    out = analysis.forcing_analysis(b, s, ["incident"], ["celsius", "humidity"], 3.0, **settings).collect()
    return {(r.minute, r.y, r.x): r for r in out}


def test_tiles_against_one_solve(spark):
    """Tiles with a wide halo give what one solve over all stations of the time gives, for every variable."""
    cells, stations = weather_case()
    got = analysed(spark, cells, stations, tile=5.0, reach=40.0, merge=1e-6)
    base = {c[1:4]: c for c in cells}
    wind = lambda s, d: (-s * math.sin(math.radians(d)), -s * math.cos(math.radians(d)))
    for t in (0, 60):
        near = [s for s in stations if abs(s[1] - t) <= 40]
        place = lambda v: min(range(20), key=lambda i: (abs(i - v), i))
        to = np.array([(y, x) for y in range(20) for x in range(20)], float)

        def solve(have, innovation):
            use = [s for s in near if have(s)]
            at = np.array([s[2:4] for s in use])
            cov = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2) / 18)
            system = cov(at, at) + 0.35**2 * np.eye(len(use))
            d = np.array([innovation(s, base[(t, place(s[2]), place(s[3]))]) for s in use])
            cross = cov(to, at)
            gain = np.einsum("kj,ji->ki", cross, np.linalg.inv(system))
            return (gain * d).sum(axis=1), np.sqrt(np.clip(1 - (cross * gain).sum(axis=1), 0, 1))

        cases = {
            "u_correction": (lambda s: True, lambda s, b: wind(s[4], s[5])[0] - wind(b[4], b[5])[0]), "v_correction": (lambda s: True, lambda s, b: wind(s[4], s[5])[1] - wind(b[4], b[5])[1]),
            "celsius": (lambda s: s[6] is not None, lambda s, b: s[6] - b[6]), "humidity": (lambda s: s[7] is not None, lambda s, b: s[7] - b[7]),
        }
        for name, (have, innovation) in cases.items():
            c, sd = solve(have, innovation)
            for (y, x), dc, ds in zip(to.astype(int).tolist(), c, sd, strict=True):
                r, b = got[(t, y, x)], base[(t, y, x)]
                want = dc if "_" in name else b[6] + dc if name == "celsius" else min(100.0, max(0.0, b[7] + dc))
                assert r[name] == pytest.approx(want, abs=1e-9)
                assert r["wind_sd" if "_" in name else f"{name}_sd"] == pytest.approx(ds, abs=1e-7)
        assert {r.station_count for k, r in got.items() if k[0] == t} == {len(near)}


def test_stations_at_one_place_are_one(spark):
    """Many reports from one mast weigh as their mean with the mean's error, in one row for each set of fields."""
    cells, _ = weather_case()
    mast = [("g", 0, 10.0, 10.0, 4.0, 90.0, 15.0 + i % 7, 50.0 if i % 2 else None) for i in range(200)]
    apart, merged = analysed(spark, cells, mast, tile=50.0, reach=40.0, merge=1e9), None
    one = [("g", 0, 10.0, 10.0, 4.0, 90.0, float(np.mean([m[6] for m in mast])), None)]
    merged = analysed(spark, cells, one, ratio=0.35 / math.sqrt(200))
    assert apart[(0, 10, 10)].celsius == pytest.approx(merged[(0, 10, 10)].celsius, abs=1e-9)
    far = analysed(spark, cells, [])
    assert far[(0, 3, 4)].celsius == 19.0 and far[(0, 3, 4)].celsius_sd == 1.0 and far[(0, 3, 4)].station_count == 0


# surfaces


def surface(**change):
    doc = {
        "schema_version": 1, "density_altitude_m": [0, 1000, 3000], "payload_fraction": [0.0, 1.0], "true_airspeed_m_s": [[60, 50], [58, 46], [50, 40]],
        "endurance_multiplier": [[1, 0.9], [0.9, 0.8], [0.7, 0.6]], "maximum_payload_fraction": [1.0, 0.9, 0.6], "metadata": {"source": "manual"},
    }
    return json.dumps(doc | change)


def test_surface_lookup(spark, tmp_path):
    (tmp_path / "a.json").write_text(surface())
    corners, payload = tables.read_surfaces(spark, str(tmp_path))
    rows = [(1, 500.0, 0.25), (2, 3000.0, 1.0), (3, -10.0, 0.5), (4, 9000.0, 2.0), (5, 1000.0, 0.0)]
    q = spark.createDataFrame(rows, "i int, altitude double, load double").withColumn("surface", F.lit("manual"))
    got = {r.i: r for r in surfaces.linear(surfaces.bilinear(q, corners, ["surface"], "altitude", "load", ["true_airspeed_m_s", "endurance_multiplier"]).drop("altitude_outside"), payload, ["surface"], "altitude", ["maximum_payload_fraction"]).collect()}
    assert got[1].true_airspeed_m_s == pytest.approx(0.5 * (57.5 + 55.0)) and got[1].maximum_payload_fraction == pytest.approx(0.95)
    assert [got[i].true_airspeed_m_s for i in (2, 3, 4, 5)] == pytest.approx([40, 55, 40, 58])
    assert [(got[i].altitude_outside, got[i].load_outside) for i in range(1, 6)] == [(False, False), (False, False), (True, False), (True, True), (False, False)]
    lost = surfaces.bilinear(q.withColumn("surface", F.lit("other")), corners, ["surface"], "altitude", "load", ["true_airspeed_m_s"]).first()
    assert lost.true_airspeed_m_s is None


@pytest.mark.parametrize("change", [{"schema_version": 2}, {"metadata": {"source": " "}}, {"metadata": {}}, {"density_altitude_m": [0, 0, 3000]}, {"payload_fraction": [0.0, 1.5]}, {"payload_fraction": [0.5]}, {"true_airspeed_m_s": [[60, 50], [58, 46]]}, {"endurance_multiplier": [[1, 0.9], [0.9, 0], [0.7, 0.6]]}, {"maximum_payload_fraction": [1.1, 0.9, 0.6]}])
def test_bad_surfaces(spark, tmp_path, change):
    (tmp_path / "a.json").write_text(surface(**change))
    with pytest.raises(PySparkException, match="breaks rules"):
        tables.read_surfaces(spark, str(tmp_path))[0].collect()


# nearest places


def test_nearest_on_the_sphere(spark):
    """A regular grid, targets just beside its points; the date line; a pole; and a spot that holds half of all places."""
    grid = [(i * 121 + j, 30 + i * 0.1, -125 + j * 0.1) for i in range(0, 101, 4) for j in range(0, 121, 4)]
    spot = [(100_000 + i, 50 + (i % 40) * 1e-6, 10 + (i // 40) * 1e-6) for i in range(800)]
    places = [*grid, *spot, (200_000, 0.0, 179.9), (200_001, 89.9, 0.0), (200_002, 89.9, 0.0)]
    points = [(1, 34.01, -120.21), (2, 35.61, -119.79), (3, 0.0, -179.95), (4, 89.95, 180.0), (5, 50.00001, 10.00001), (6, -90.0, 0.0), (7, 50 + 7e-6, 10 + 3e-6), (8, None, 0.0)]

    def chord(a, b):
        v = [(math.cos(math.radians(p)) * math.cos(math.radians(q)), math.cos(math.radians(p)) * math.sin(math.radians(q)), math.sin(math.radians(p))) for p, q in (a, b)]
        return sum((x - y) ** 2 for x, y in zip(*v, strict=True))

    out = spatial.nearest_on_sphere(spark.createDataFrame(points, "p long, lat double, lon double"), spark.createDataFrame(places, "q long, lat double, lon double"), "p", "q", 16)
    got = {r.p: r for r in out.collect()}
    assert set(got) == set(range(1, 8))
    for p, lat, lon in points[:-1]:
        best = min(chord((lat, lon), x[1:]) for x in places)
        q = next(x for x in places if x[0] == got[p].q)
        assert chord((lat, lon), q[1:]) == pytest.approx(best, rel=1e-6, abs=1e-18)
        assert got[p].distance_km == pytest.approx(2 * 6371.0088 * math.asin(math.sqrt(best) / 2), rel=1e-5, abs=1e-5)
    assert got[3].q == 200_000 and got[4].q == 200_001  # across the date line; of two at one place the lower id


def test_nearest_point_of_few_places(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "p long, x double, y double")
    one = spark.createDataFrame([(7, 1.0, 1.0), (6, 1.0, 1.0)], "q long, x double, y double")
    assert sorted((r.p, r.q) for r in spatial.nearest_point(points, one, "p", "q").collect()) == [(1, 6), (2, 6)]
    assert {r.q for r in spatial.nearest_point(points, one.limit(0), "p", "q").collect()} == {None}


# frames and areas


def test_equal_frames_are_dormant(spark):
    cells = [("a", f, y, x) for f, n in enumerate((2, 4, 4, 3, 3)) for y in range(n) for x in range(n)]
    cells += [("b", 0, 1, 2), ("b", 0, 2, 1), ("b", 1, 1, 1), ("b", 1, 2, 2), ("b", 1, 2, 2)]  # as many cells, others
    fr = spark.createDataFrame([("a", f, 10.0 * f) for f in range(6)] + [("b", f, None) for f in range(2)], "k string, f int, area double")
    out = frames.progression(fr, spark.createDataFrame(cells, "k string, f int, y int, x int").repartition(3), ["k"], "f", ["y", "x"])
    got = {(r.k, r.f): (r.n_cells, r.dormant, r.fell, r.lost) for r in out.collect()}
    assert [got[("a", f)] for f in range(6)] == [(4, False, False, 0), (16, False, False, 0), (16, True, False, 0), (9, False, True, 7), (9, True, False, 0), (0, False, True, 9)]
    assert got[("b", 1)] == (2, False, False, 0)
    audit = {r.k: r for r in frames.progression_audit(out, ["k"], "f", "area", 2.0).collect()}
    assert (audit["a"].n_dormant, audit["a"].n_fell, audit["a"].most_lost, audit["a"].last_covered) == (2, 2, 9, 0.0) and audit["b"].median_covered is None


def test_area_of_overlapping_polygons(spark):
    """Triangles that cross, touch, contain each other and repeat, against a fine count of points inside any."""
    rng = np.random.default_rng(12)
    shapes = [[tuple(map(float, p)) for p in rng.uniform(0, 10, (3, 2))] for _ in range(6)]
    shapes += [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0)], shapes[0], [(1.0, 1.0), (3.0, 1.0), (5.0, 1.0)]]
    df = spark.createDataFrame([("k", [{"x": x, "y": y} for x, y in s]) for s in shapes] + [("one", [{"x": x, "y": y} for x, y in shapes[6]])], "k string, polygon array<struct<x: double, y: double>>")
    got = {r.k: r.area for r in frames.union_area(df, ["k"], "polygon", 1.0).collect()}
    g = (np.arange(1500) + 0.5) / 150
    xs, ys = np.meshgrid(g, g)
    inside = np.zeros(xs.shape, bool)
    for s in shapes:
        odd = np.zeros(xs.shape, bool)
        for (x0, y0), (x1, y1) in zip(s, s[1:] + s[:1]):
            if y0 != y1:
                odd ^= ((y0 > ys) != (y1 > ys)) & (xs < (x1 - x0) * (ys - y0) / (y1 - y0) + x0)
        inside |= odd
    assert got["k"] == pytest.approx(inside.mean() * 100, abs=0.05) and got["one"] == pytest.approx(4.0)


# windows and resampling


@pytest.mark.parametrize("size", [3, 5, 9])
def test_sliding_windows(spark, size):
    v = np.random.default_rng(size).integers(0, 50, (7, 11)).astype(float)
    rows = [("g", y, x, float(v[y, x])) for y in range(7) for x in range(11) if (y, x) != (3, 4)]
    g = spark.createDataFrame(rows, "k string, y int, x int, v double")
    r = size // 2
    have = {(y, x): z for _, y, x, z in rows}
    for how, f in (("max", max), ("min", min), ("sum", sum), ("mean", lambda w: sum(w) / size**2), ("inner", lambda w: sum(w) / len(w))):
        for c in raster.sliding(g, ["k"], "v", size, how, "o").collect():
            assert c.o == pytest.approx(f([z for (y, x), z in have.items() if abs(y - c.y) <= r and abs(x - c.x) <= r]))
    with pytest.raises(ValueError):
        raster.sliding(g, ["k"], "v", 4, "max", "o")


@pytest.mark.parametrize("new", [(5, 8), (14, 22), (7, 11), (3, 25)])
def test_resampling(spark, new):
    v = np.random.default_rng(1).uniform(0, 9, (7, 11))
    g = spark.createDataFrame([("g", y, x, float(v[y, x])) for y in range(7) for x in range(11)], "k string, y int, x int, v double")
    at = {m: {(r.y, r.x): r.v for r in raster.resample(g, ["k"], "v", (7, 11), new, m).collect()} for m in ("area", "bilinear", "nearest")}
    sy, sx = 7 / new[0], 11 / new[1]
    for i in range(new[0]):
        for j in range(new[1]):
            wy = [max(0.0, min(y + 1, (i + 1) * sy) - max(y, i * sy)) for y in range(7)]
            wx = [max(0.0, min(x + 1, (j + 1) * sx) - max(x, j * sx)) for x in range(11)]
            assert at["area"][(i, j)] == pytest.approx(np.array(wy) @ v @ np.array(wx) / (sy * sx))
            y, x = (min(n - 1.0, max(0.0, (k + 0.5) * s - 0.5)) for n, k, s in ((7, i, sy), (11, j, sx)))
            a, b = min(int(y), 5), min(int(x), 9)
            p, q = y - a, x - b
            assert at["bilinear"][(i, j)] == pytest.approx((1 - p) * ((1 - q) * v[a, b] + q * v[a, b + 1]) + p * ((1 - q) * v[a + 1, b] + q * v[a + 1, b + 1]))
            assert at["nearest"][(i, j)] == v[min(6, math.floor(i * sy)), min(10, math.floor(j * sx))]


# segments


def test_segments_meet(spark):
    cases = [((0, 0, 4, 4), (0, 4, 4, 0), True), ((0, 0, 4, 0), (4, 0, 8, 3), True), ((0, 0, 4, 0), (5, 0, 8, 0), False), ((0, 0, 4, 0), (2, 0, 8, 0), True), ((0, 0, 4, 4), (1, 0, 5, 4), False), ((0, 0, 4, 0), (2, 1, 2, 5), False), ((0, 0, 4, 0), (2, 0, 2, 5), True), ((1, 1, 1, 1), (0, 0, 2, 2), True), ((1, 2, 1, 2), (0, 0, 2, 2), False), ((0, 0, 10, 1), (5, 0.4, 5, 3), True), ((0, 0, 10, 1), (5, 0.4, 5, -3), False), ((0, 0, 10, 1), (5, 0.6, 5, 3), False)]
    df = spark.createDataFrame([(*map(float, a), *map(float, b), w) for a, b, w in cases], "a double, b double, c double, d double, e double, f double, g double, h double, w boolean")
    c = lambda x, y: (F.col(x), F.col(y))
    assert all(r.m == r.w for r in df.withColumn("m", fleet.segments_cross(c("a", "b"), c("c", "d"), c("e", "f"), c("g", "h"))).collect())


# published tables


def test_publishing_goes_on_where_it_was_killed(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), spark.range(20).withColumn("v", F.col("id") * 2)
    manifest.publish(rows.filter("id < 8"), path, ["id"], "c")
    real = manifest._names
    for stop in ("before the data", "before the manifest"):  # killed at each rename
        calls = []

        class Files:
            def __init__(self, files):
                self.files = files

            def __getattr__(self, name):
                return getattr(self.files, name)

            def rename(self, a, b):
                calls.append(b)
                if len(calls) == (1 if stop == "before the data" else 2):
                    raise KeyboardInterrupt
                return self.files.rename(a, b)

        files = manifest._files
        with monkeypatch.context() as m:
            m.setattr(manifest, "_files", lambda s, p: (Files(files(s, p)[0]), files(s, p)[1]))
            with pytest.raises(KeyboardInterrupt):
                manifest.publish(rows, path, ["id"], "c")
        assert manifest.published(spark, path, "c").count() == 8
    manifest.publish(rows, path, ["id"], "c")
    got = manifest.published(spark, path, "c", ["id"])
    assert sorted(r.id for r in got.collect()) == list(range(20)) and len(real(spark, path, "_manifest")) == 2
    assert not [n for n in real(spark, path) if n.startswith("_staging")]
    assert manifest.index(spark, path, "c", ["id"]).groupBy("part").count().count() == 2


def test_publishing_verifies_what_is_there(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(5).withColumn("v", F.col("id") * 2)
    assert manifest.published(spark, path, "c") is None
    manifest.publish(rows, path, ["id"], "c")
    with pytest.raises(ValueError, match="twice"):
        manifest.publish(rows.union(rows), path, ["id"], "c")
    with pytest.raises(PySparkException, match="another contract"):
        manifest.manifest(spark, path, "other").collect()
    assert manifest.file_changes(spark, path, "c").count() == 0
    part = next((tmp_path / "t").glob("part-*"))
    spark.range(5).select((F.col("id") + 100).alias("id"), (F.col("id") * 2).alias("v"), F.lit("x").alias("_key")).coalesce(1).write.parquet(str(tmp_path / "new"))
    for old in part.glob("*.parquet"):
        old.write_bytes(next((tmp_path / "new").glob("*.parquet")).read_bytes())
    for crc in part.glob(".*.crc"):
        crc.unlink()
    assert {r.change for r in manifest.file_changes(spark, path, "c").collect()} == {"changed"}
    with pytest.raises(ValueError, match="is changed"):
        manifest.publish(rows, path, ["id"], "c")
    with pytest.raises(PySparkException, match="differs from its digest"):
        manifest.published(spark, path, "c", ["id"]).collect()


# summaries that use exact quantiles


def test_summary_without_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0), ("b", None)], "c string, v double")
    r = profile.summary(df, [], "c", "v").first()
    assert (r.n, r.median, r.n_clusters, r.weighted_mean) == (3, 3.0, 2, 5.0)
