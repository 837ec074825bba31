"""Moisture of dead and live fuels along weather series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.functions import weather as wx
from cinderframe.operators.timeseries import lagged, trailing

#: Moistures lie in this range.
RANGE = (0.0, 3.0)


def _step(m: np.ndarray, up: float, low: float, target: float, pull: float) -> np.ndarray:
    """Moistures after one step: towards target in rain (else it is not a number), or to the nearer equilibrium."""
    to = np.maximum(np.minimum(m, up), low) if target != target else target
    return np.clip(m + (to - m) * pull, *RANGE)


def _chunk_map(ups: np.ndarray, lows: np.ndarray, targets: np.ndarray, pulls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's rows together as one map from the moisture before them to that behind them.

    Every step is increasing and linear but for bends at its equilibria. So the map is a line through points (x, y):
    wherever it crosses an equilibrium a point is added, then all points take the step.
    """
    x = y = np.array(RANGE)
    for up, low, target, pull in zip(*(np.asarray(c, float).tolist() for c in (ups, lows, targets, pulls)), strict=True):
        if pull != pull:
            continue  # the first row of a key
        if target != target:
            for bend in (low, up):
                k = int(np.searchsorted(y, bend))
                if 0 < k < len(y) and y[k - 1] < bend < y[k]:
                    at = x[k - 1] + (bend - y[k - 1]) / (y[k] - y[k - 1]) * (x[k] - x[k - 1])
                    x, y = np.insert(x, k, at), np.insert(y, k, bend)
        y = _step(y, up, low, target, pull)
        if len(y) > 2:
            flat = np.concatenate(([False], (y[1:-1] == y[:-2]) & (y[1:-1] == y[2:]), [False]))
            x, y = x[~flat], y[~flat]
    return x, y


def _maps(up: pd.Series, low: pd.Series, to: pd.Series, pull: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_chunk_map(*r) for r in zip(up, low, to, pull, strict=True)], columns=["x", "y"])


def _starts(first: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """The moisture before each chunk of a key, from the chunks' maps in turn."""
    out = []
    for m, xs, ys in zip(first, x, y, strict=True):
        row = []
        for a, b in zip(xs, ys, strict=True):
            row.append(m)
            m = float(np.interp(m, a, b))
        out.append(row)
    return pd.Series(out)


def _replay(start: pd.Series, *columns: pd.Series) -> pd.Series:
    """The moisture at every row of a chunk."""
    low_end, high_end = RANGE
    out = []
    for m, *steps in zip(start, *columns, strict=True):
        row = []
        for up, low, target, pull in zip(*(np.asarray(c, float).tolist() for c in steps), strict=True):
            if pull == pull:
                to = max(min(m, up), low) if target != target else target
                m = min(max(m + (to - m) * pull, low_end), high_end)
            row.append(m)
        out.append(row)
    return pd.Series(out)


def dead_moisture(rows: DataFrame, keys: list[str], time: str, celsius: str, humidity: str, rain: str, lag_hours: float, initial: float | None = None, chunk: float = 43_200.0) -> DataFrame:
    """(keys, time, moisture) along each key's series (time in minutes): a step from each row to the next under the weather
    halfway between; at first `initial`, or the middle of the first row's equilibria. Times of a key differ.

    The state depends on all before, but a step is an increasing map of it, linear in pieces, and so are many steps.
    Each chunk of time becomes one such map; a short fold over a key's maps gives the moisture before each chunk, and
    with it every chunk writes its rows. So a key with any number of rows is many groups of one chunk.
    """
    x = lagged(rows.select(*keys, time, celsius, humidity, rain), keys, time, [], [time, celsius, humidity, rain], chunk)
    half = lambda c: (F.col(c) + F.col(f"_prev.{c}")) / 2
    here, between = wx.moisture_equilibria(F.col(celsius), F.col(humidity)), wx.moisture_equilibria(half(celsius), half(humidity))
    start = F.lit(initial) if initial is not None else 0.5 * (here[0] + here[1])
    to, rate = wx.rain_response(half(rain), lag_hours)
    pull = -F.expm1(-(F.col(time) - F.col(f"_prev.{time}")) * rate)
    step = F.struct(F.col(time).alias("at"), between[0].alias("up"), between[1].alias("low"), to.alias("to"), pull.alias("pull"))
    x = x.select(*keys, "_c", step.alias("s"), F.when(F.col("_prev").isNull(), start.cast("double")).alias("_first"))
    parts = x.groupBy(*keys, "_c").agg(F.sort_array(F.collect_list("s")).alias("s"), F.first("_first", True).alias("_first"))
    columns = [F.col(f"s.{c}") for c in ("up", "low", "to", "pull")]
    maps = parts.select(*keys, "_c", "_first", F.pandas_udf(_maps, "x array<double>, y array<double>")(*columns).alias("m"))
    chain = maps.groupBy(*keys).agg(F.first("_first", True).alias("_first"), F.sort_array(F.collect_list(F.struct("_c", "m"))).alias("c"))
    starts = chain.select(*keys, F.col("c._c").alias("_c"), F.pandas_udf(_starts, "array<double>")("_first", F.col("c.m.x"), F.col("c.m.y")).alias("_start"))
    starts = starts.select(*keys, F.explode(F.arrays_zip("_c", "_start")).alias("z")).select(*keys, "z._c", "z._start")
    out = parts.join(starts, [*keys, "_c"]).select(*keys, F.col("s.at").alias("at"), F.pandas_udf(_replay, "array<double>")("_start", *columns).alias("moisture"))
    return out.select(*keys, F.explode(F.arrays_zip("at", "moisture")).alias("z")).select(*keys, F.col("z.at").alias(time), "z.moisture")


def hourly_moisture(rows: DataFrame, days: DataFrame, keys: list[str], ts: str, longitude: float, columns: tuple[str, ...] = ("herbaceous", "woody")) -> DataFrame:
    """rows with the live moisture of their local solar day, from live_moisture(); null on a day without one."""
    day = F.to_date(F.timestamp_micros((F.unix_micros(F.col(ts).cast("timestamp")) + round(longitude / 15 * 3.6e9)).cast("long")))
    return rows.withColumn("_day", day).join(days.select(*keys, F.col("day").alias("_day"), *columns), [*keys, "_day"], "left").drop("_day")


def local_days(rows: DataFrame, keys: list[str], ts: str, celsius: str, humidity: str, rain: str, longitude: float) -> DataFrame:
    """Per key and local solar day: least temperature, greatest vapour pressure deficit, and rain times the hours since the sample before."""
    w = Window.partitionBy(*keys).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = (micros - F.lag(micros).over(w)) / 3.6e9
    hours = F.coalesce(gap, (F.lead(micros).over(w) - micros) / 3.6e9, F.lit(1.0))
    day = F.to_date(F.timestamp_micros((micros + round(longitude / 15 * 3.6e9)).cast("long")))
    x = rows.withColumns({"_hours": hours, "day": day})
    deficit = wx.saturation_vapour_pressure_pa(F.col(celsius)) * (1 - F.col(humidity) / 100)
    return x.groupBy(*keys, "day").agg(F.min(celsius).alias("t_min"), F.max(deficit).alias("vpd_max"), F.sum(F.col(rain) * F.col("_hours")).alias("rain"))


def live_moisture(days: DataFrame, keys: list[str], latitude: float, window: int = 28, greenup: float = 0.20) -> DataFrame:
    """(keys, day, gsi, herbaceous, woody) from local_days(): the growing-season index of temperature, deficit, daylight and
    trailing rain, averaged over the last days, and the live moistures it stands for."""
    x = trailing(days, keys, "day", "rain", window, "_rain")
    light = wx.day_length_hours(F.lit(float(latitude)), F.dayofyear("day").cast("double")) * 3600
    index = wx.ramp(F.col("t_min"), -2.0, 5.0) * (1 - wx.ramp(F.col("vpd_max"), 900.0, 4100.0)) * wx.ramp(light, 36_000.0, 39_600.0) * wx.ramp(F.col("_rain"), 0.0, 10.0)
    x = trailing(x.withColumn("_gsi", index), keys, "day", "_gsi", window, "gsi", "mean")
    green = wx.clip((F.col("gsi") - greenup) / (1 - greenup), 0.0, 1.0)
    return x.select(*keys, "day", "gsi", (0.30 + 2.20 * green).alias("herbaceous"), (0.60 + 1.40 * green).alias("woody"))
