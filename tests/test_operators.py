"""Operators on small inputs whose results can be worked out by hand."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from cinderframe.functions import weather
from cinderframe.operators import audit, raster, scoring, selection, statistics, timeseries


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([("a", 0.0, 10.0), ("a", 10.0, 20.0), ("a", 3000.0, 50.0), ("b", 5.0, 1.0)], "k string, t double, v double")


def test_asof_clamps_to_the_first_sample(spark, series):
    q = spark.createDataFrame([("a", -5.0), ("a", 10.0), ("a", 2999.0), ("a", 9000.0), ("c", 1.0)], "k string, t double")
    assert values(timeseries.asof_last(series, q, ["k"], "t", "v"), "t", "v") == [(-5.0, 10.0), (1.0, None), (10.0, 20.0), (2999.0, 20.0), (9000.0, 50.0)]


def test_linear_interpolation_and_circle(spark, series):
    q = spark.createDataFrame([("a", 5.0), ("a", 1505.0), ("b", 99.0)], "k string, t double")
    assert values(timeseries.asof_linear(series, q, ["k"], "t", "v"), "t", "v") == [(5.0, 15.0), (99.0, 1.0), (1505.0, 35.0)]
    angles = spark.createDataFrame([("a", 0.0, 359.0), ("a", 10.0, 1.0)], "k string, t double, v double")
    at = spark.createDataFrame([("a", 5.0)], "k string, t double")
    [(v,)] = values(timeseries.asof_linear(angles, at, ["k"], "t", "v", 360.0), "v")
    assert min(v, 360 - v) < 1e-9


def test_nearest_prefers_the_earlier(spark, series):
    q = spark.createDataFrame([("a", 5.0), ("a", 6.0)], "k string, t double")
    assert values(timeseries.nearest(series, q, ["k"], "t", "v"), "t", "v") == [(5.0, 10.0), (6.0, 20.0)]


def test_overlay_covers_both_ends(spark, series):
    b = spark.createDataFrame([("a", -1.0, 0.0), ("a", 0.0, 0.0), ("a", 3000.0, 0.0), ("a", 3001.0, 0.0)], "k string, t double, v double")
    assert values(timeseries.overlay(b, series, ["k"], "t", "v"), "t", "v") == [(-1.0, 0.0), (0.0, 10.0), (3000.0, 50.0), (3001.0, 0.0)]


def test_longest_run_takes_the_first_of_equals(spark):
    t = [0, 10, 20, 100, 110, 120]
    rows = spark.createDataFrame([("a", float(x), i) for i, x in enumerate(t)], "k string, t double, i int")
    assert values(timeseries.longest_run(rows, ["k"], "t", "i", 5.0, 15.0), "k", "run", "start") == [("a", 2, 2)]


def test_trim_keeps_one_sample_each_side(spark):
    rows = spark.createDataFrame([("a", 60.0 * i) for i in range(8)], "k string, t double")
    assert values(timeseries.trim(rows, ["k"], "t", F.lit(210.0), F.lit(330.0)), "rebased") == [(-30.0,), (30.0,), (90.0,), (150.0,)]


@pytest.mark.parametrize("size", [1, 2, 100])
def test_folds_do_not_depend_on_chunks(spark, size):
    rows = spark.createDataFrame([("a", i, float(v), d, g) for i, (v, d, g) in enumerate([(1, False, 2.0), (2, False, 1.0), (4, True, 3.0), (8, False, 0.5), (16, False, 1.0)])], "k string, t int, v double, d boolean, g double")
    chunk = F.floor(F.col("t") / size)
    assert values(timeseries.discounted_return(rows, ["k"], chunk, ["t"], "v", 0.5, F.col("d")), "ret") == [(3.0,)]
    assert values(timeseries.discounted_return(rows, ["k"], chunk, ["t"], "v", 0.5), "ret") == [(5.0,)]
    want, adv, ahead = [], 0.0, 0.0
    for v, d, g in reversed([(1, 0, 2.0), (2, 0, 1.0), (4, 1, 3.0), (8, 0, 0.5), (16, 0, 1.0)]):
        adv = v + 0.9 * ahead * (not d) - g + 0.9 * 0.5 * (not d) * adv
        ahead = g
        want.insert(0, round(adv, 9))
    got = timeseries.advantages(rows, ["k"], chunk, ["t"], "v", "g", "d", 0.9, 0.5)
    assert [(t, round(x, 9)) for t, x in values(got, "t", "advantage")] == list(enumerate(want))


def test_dead_moisture_keeps_still_dries_and_soaks(spark):
    from cinderframe.operators import fuel

    rows = [(k, 60.0 * i, 25.0, 35.0, 2.0 if k == "rain" else 0.0) for k in ("still", "dry", "rain") for i in range(2)]
    df = spark.createDataFrame(rows, "k string, t double, c double, h double, r double")
    upper, lower = df.limit(1).select(*weather.moisture_equilibria(F.col("c"), F.col("h"))).first()
    step = lambda start: dict(values(fuel.dead_moisture(df, ["k"], "t", "c", "h", "r", 1.0, start).filter("t = 60"), "k", "moisture"))
    assert step((upper + lower) / 2)["still"] == pytest.approx((upper + lower) / 2)
    assert step(0.01)["dry"] == pytest.approx(0.01 + (lower - 0.01) * (1 - math.exp(-1)))
    assert step(0.01)["rain"] == pytest.approx(0.01 + (2.5 - 0.01) * (1 - math.exp(-(1 - math.exp(-1.95 / 8)) / 14)))


def test_rows_without_a_split_fail(spark):
    rows = spark.createDataFrame([(1, 2000), (2, 1900)], "k int, y int")
    assert audit.split_of(rows, "k", {}, F.col("y"), {2000: "a"}, strict=False).filter("split is null").count() == 1
    with pytest.raises(Exception, match="no split"):
        audit.split_of(rows, "k", {}, F.col("y"), {2000: "a"}).collect()


def test_strict_pairs_fail_on_other_keys(spark):
    from cinderframe.operators import profile

    df = lambda *k: spark.createDataFrame([(x, 1.0) for x in k], "k string, v double")
    assert profile.strictly_paired(df("a", "b"), df("b", "a"), ["k"], "v").count() == 2
    for other in (df("a"), df("a", "b", "c"), df("a", "b", "b")):
        with pytest.raises(Exception, match="differ"):
            profile.strictly_paired(df("a", "b"), other, ["k"], "v").collect()


def test_signed_pairs_keep_single_arms(spark):
    rows = spark.createDataFrame([("a", "t", 3.0), ("a", "c", 1.0), ("b", "c", 2.0), ("c", "x", 9.0)], "k string, arm string, v double")
    assert values(statistics.signed_pairs(rows, ["k"], "arm", "t", "c", "v"), "k", "delta") == [("a", 2.0), ("b", -2.0)]


def test_log_weights_without_a_finite_one_are_uniform(spark):
    rows = spark.createDataFrame([("a", float("-inf")), ("a", float("nan")), ("b", 1000.0), ("b", 1000.0 + math.log(3))], "k string, w double")
    assert [(k, round(w, 9)) for k, w in values(statistics.log_weights(rows, ["k"], "w"), "k", "weight")] == [("a", 0.5), ("a", 0.5), ("b", 0.25), ("b", 0.75)]


def test_resampling_draws_n(spark):
    rows = spark.createDataFrame([("a", i, w) for i, w in enumerate([0.5, 0.25, 0.125, 0.125])], "k string, i int, w double")
    assert values(statistics.resample(rows, ["k"], "i", "w", 8), "i", "times") == [(0, 4), (1, 2), (2, 1), (3, 1)]


def test_numbering_is_by_order(spark):
    rows = spark.range(0, 1000, 3).withColumn("v", F.rand(1))
    assert [r.number for r in statistics.numbered(rows, "id").orderBy("id").collect()] == list(range(334))


def test_reliability_bins_close_the_last(spark):
    rows = spark.createDataFrame([(1.0, 1), (0.0, 0), (0.3, 1), (0.29999, 0)], "p double, y int")
    assert values(scoring.reliability(rows, [], "p", "y"), "bin", "n") == [(0, 1), (2, 1), (3, 1), (9, 1)]


def grid(spark, h, w):
    return spark.createDataFrame([("g", y, x, float(10 * y + x)) for y in range(h) for x in range(w)], "k string, y int, x int, v double")


def test_wide_rows_by_envelope_and_at_once_agree():
    import numpy as np

    rng = np.random.default_rng(0)
    x, f = np.arange(1500.0), np.where(rng.random(1500) < 0.5, rng.integers(0, 60, 1500) ** 2.0, np.inf)
    have = np.flatnonzero(np.isfinite(f))
    assert raster._along_row(x, f) == pytest.approx(((x[:, None] - x[have]) ** 2 + f[have]).min(axis=1))
    assert np.isinf(raster._along_row(x, np.full(1500, np.inf))).all()


def test_distance_is_exact(spark):
    g = grid(spark, 9, 11)
    mask = [(0, 0), (3, 7), (8, 2)]
    m = spark.createDataFrame([("g", *c) for c in mask], "k string, y int, x int")
    for y, x, d in values(raster.distance(m, g, ["k"]), "y", "x", "d"):
        assert d == pytest.approx(min(math.hypot(y - a, x - b) for a, b in mask))


def test_boundary_counts_the_edge_of_the_grid(spark):
    m = grid(spark, 4, 4)
    assert len(values(raster.boundary(m, ["k"]), "y", "x")) == 12


def test_dilation_does_not_wrap(spark):
    g = grid(spark, 5, 5)
    m = spark.createDataFrame([("g", 0, 0)], "k string, y int, x int")
    assert values(raster.dilate(m, g, ["k"], raster.disc(1.0)), "y", "x") == [(0, 0), (0, 1), (1, 0)]


def test_slope_is_one_sided_at_the_edges(spark):
    assert set(values(raster.slope(grid(spark, 3, 3), ["k"], "v", 1.0), "dy", "dx")) == {(10.0, 1.0)}


def test_footprint_keeps_the_volume(spark):
    drops = spark.createDataFrame([("a", 3, 4, 30.0, 900.0)], "k string, y int, x int, heading_deg double, volume double")
    assert raster.footprint(drops, ["k"], 3, 2.0, 1.0).agg(F.sum("share")).first()[0] == pytest.approx(900)


def test_blur_repeats_the_edge(spark):
    flat = grid(spark, 4, 4).withColumn("v", F.lit(2.0))
    assert all(v == pytest.approx(2) for (v,) in values(raster.blur(flat, ["k"], "v", 1.0, "b"), "b"))


@pytest.mark.parametrize("seed", range(6))
def test_best_matching_against_every_assignment(spark, seed):
    """Values with many ties, capacities of 0 to 2: the picks are the first of those with the greatest total."""
    import random

    rnd = random.Random(seed)
    table = {(r, t): float(rnd.randint(0, 3)) for r in range(4) for t in range(3) if rnd.random() < 0.8}
    room = {t: rnd.randint(0, 2) for t in range(3)}
    pairs = spark.createDataFrame([(1, r, t, v, room[t]) for (r, t), v in table.items()], "c int, r int, t int, v double, n int")
    got = [(x.r, x.t, x.v) for x in selection.best_matching(pairs, ["c"], "r", "t", "v", "n").orderBy("r").collect()]
    every = []
    for choice in itertools.product([None, 0, 1, 2], repeat=4):
        picks = tuple((r, t, table.get((r, t))) for r, t in enumerate(choice) if t is not None)
        if all(v is not None for *_, v in picks) and all(choice.count(t) <= room[t] for t in room):
            every.append((-sum(v for *_, v in picks), picks))
    assert tuple(got) == min(every)[1]


def test_greedy_matching_takes_the_best_left(spark):
    table = {(r, t): float((7 * r + 5 * t * t + r * t) % 11) for r in range(4) for t in range(4)}
    pairs = spark.createDataFrame([(1, r, t, v) for (r, t), v in table.items()], "c int, r int, t int, v double")
    taken = []
    for r in range(4):
        t = min((t for t in range(4) if t not in [x for _, x in taken]), key=lambda t: (-table[r, t], t))
        taken.append((r, t))
    assert values(selection.greedy_matching(pairs, ["c"], "r", "t", "v"), "r", "t") == taken


def test_optimal_interpolation_against_the_equations(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    cells = [("a", int(y), int(x)) for y in range(6) for x in range(5)]
    obs = [("a", int(y), int(x), float(rng.normal())) for y, x in {(1, 1), (4, 3), (2, 0)}]
    got = raster.optimal_interpolation(spark.createDataFrame(obs, "k string, oy int, ox int, innovation double"), spark.createDataFrame(cells, "k string, y int, x int"), ["k"], 2.0, 0.3, blocks=3)
    near = lambda a, b: math.exp(-((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) / 8)
    places = [(o[1], o[2]) for o in obs]
    inverse = np.linalg.inv([[near(p, q) + 0.09 * (p == q) for q in places] for p in places])
    for r in got.collect():
        cross = np.array([near((r.y, r.x), p) for p in places])
        assert r.correction == pytest.approx(cross @ inverse @ [o[3] for o in obs]) and r.sd == pytest.approx(math.sqrt(max(0, 1 - cross @ inverse @ cross)))


def test_round_robin_and_quartiles(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "s string, i int")
    assert values(selection.round_robin(rows, ["s"], ["i"], 3), "s", "i") == [("a", 0), ("a", 1), ("b", 9)]


def test_null_breaks_a_rule(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("a", -1)], "k string, v int")
    assert values(audit.violations(rows, ["k"], {"positive": F.col("v") > 0}), "rule", "n_broken") == [("positive", 2)]
    with pytest.raises(Exception, match="bad value"):
        audit.require(rows, F.coalesce(F.col("v") > 0, F.lit(False)), "bad value").collect()


def test_tree_changes(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "p string, d string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "p string, d string")
    assert values(audit.tree_changes(a, b, "p", "d"), "p", "change") == [("w", "added"), ("y", "changed"), ("z", "removed")]


def test_wind_round_trip(spark):
    df = spark.createDataFrame([(5.0, float(d)) for d in range(0, 360, 45)], "s double, d double")
    u, v = weather.wind_components(F.col("s"), F.col("d"))
    s, d = weather.wind_from(u, v)
    for r in df.select("d", s.alias("s2"), d.alias("d2")).collect():
        assert r.s2 == pytest.approx(5) and min(abs(r.d - r.d2), 360 - abs(r.d - r.d2)) < 1e-9
