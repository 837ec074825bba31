"""Weather analyses: a gridded background corrected by stations, solved tile by tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cinderframe.functions import weather as wx
from cinderframe.operators.timeseries import band_join

#: Variables beside the wind: the limits of their analysis, null for none.
LIMITS = {"celsius": (None, None), "humidity": (0.0, 100.0)}
#: Limits of every other variable, which are moistures.
MOISTURE = (0.01, 3.0)


def _tile_solves(fields: list[str], length: float, ratio: float) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    near = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(axis=2) / (2 * length * length))

    def run(_key: tuple, stations: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        """Corrections (c_) and deviations (s_) of a tile's cells: one solve for all fields that the same stations report."""
        out = cells.drop(columns=["_ty", "_tx"])
        to, at = cells[["y", "x"]].to_numpy(float), stations[["y", "x"]].to_numpy(float)
        error = ratio * ratio / stations["n"].to_numpy(float)
        have = stations[fields].notna().to_numpy().T
        for mask in np.unique(have, axis=0):
            mine = [f for f, h in zip(fields, have, strict=True) if (h == mask).all()]
            cross = near(to, at[mask])
            right = np.hstack([stations.loc[mask, mine].to_numpy(float), cross.T])
            solved = np.linalg.solve(near(at[mask], at[mask]) + np.diag(error[mask]), right) if mask.any() else right
            sd = np.sqrt(np.clip(1 - (cross * solved[:, len(mine) :].T).sum(axis=1), 0, 1))
            for k, f in enumerate(mine):
                out[f"c_{f}"], out[f"s_{f}"] = cross @ solved[:, k], sd
        return out

    return run


def interpolate_tiles(stations: DataFrame, cells: DataFrame, keys: list[str], fields: list[str], length: float, ratio: float, tile: float, reach: float, merge: float) -> DataFrame:
    """cells with `c_` (correction) and `s_` (posterior deviation) of every field from the stations' innovations.

    Gaussian covariances of the given length, and an error of `ratio` times the field's own deviation. stations holds
    keys, y, x and the fields, null where a station lacks one; cells holds keys, y and x, in the same units. The plane is
    cut into square tiles; a tile is solved with the stations within `reach` of it, three lengths or more. Stations
    that report the same fields within a square of `merge` are one at their mean place, with the error of their
    mean, which changes nothing where they stand together. So a group has at most (tile / merge + 2 reach / merge + 1)^2
    stations for each set of fields, however dense the network.
    """
    pattern = F.concat(*[F.when(F.col(f).isNull(), "0").otherwise("1") for f in fields])
    merged = stations.groupBy(*keys, F.floor(F.col("y") / merge).alias("_by"), F.floor(F.col("x") / merge).alias("_bx"), pattern.alias("_has"))
    merged = merged.agg(F.avg("y").alias("y"), F.avg("x").alias("x"), F.count("*").alias("n"), *[F.avg(f).alias(f) for f in fields]).drop("_by", "_bx", "_has")
    for c in "yx":
        merged = merged.withColumn(f"_t{c}", F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))))
    own = cells.select(*[F.col(c).alias(c) for c in cells.columns])  # columns of its own, though stations come from the same table
    tiled = own.withColumns({f"_t{c}": F.floor(F.col(c) / tile) for c in "yx"})
    group = [*keys, "_ty", "_tx"]
    merged = merged.join(tiled.select(*group).distinct(), group, "left_semi")  # tiles without cells need no solve
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema] + [f"c_{f} double, s_{f} double" for f in fields])
    return merged.groupBy(*group).cogroup(tiled.groupBy(*group)).applyInPandas(_tile_solves(fields, length, ratio), kinds)


def forcing_analysis(background: DataFrame, stations: DataFrame, keys: list[str], others: list[str], length: float, ratio: float = 0.35, window: float = 40.0, tile: float | None = None, reach: float | None = None, merge: float | None = None) -> DataFrame:
    """The background (keys, minute, y, x, speed, direction and others) corrected by stations (keys, minute, y, x and the
    same, null where not reported) that observed within `window` minutes of its time.

    Wind is analysed in its components, where both speed and direction are reported; its direction is never averaged.
    An innovation is a report minus the background of the nearest cell (per axis; of two as near the lower). Gives
    keys, minute, y, x, speed, direction, u_correction, v_correction, wind_sd, each other variable within its limits and
    its `_sd`, and station_count, the stations in the window. Deviations are shares of the background's own. Where no
    station is near, the background stays and deviations are 1. Lengths are in cells.
    """
    tile, reach, merge = tile or 4 * length, reach or 4 * length, merge or length / 4
    u, v = wx.wind_components(F.col("speed"), F.col("direction"))
    fields = ["u", "v", *others]
    base = background.withColumns({"u": u, "v": v})
    box = base.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in "yx" for n, f in (("lo", F.min), ("hi", F.max))])
    times = base.select(*keys, "minute").distinct()
    met = band_join(times, stations.withColumns({"u": u, "v": v}), keys, "minute", window).select(*[F.col(f"l.{k}") for k in keys], F.col("l.minute").alias("minute"), *[F.col(f"r.{c}").alias(c) for c in ("y", "x", *fields)])
    counts = met.groupBy(*keys, "minute").agg(F.count("*").alias("station_count"))
    cell = lambda c: F.greatest(F.col(f"_lo{c}"), F.least(F.col(f"_hi{c}"), F.ceil(F.col(c) - 0.5)))
    met = met.join(box, keys).select(*keys, "minute", "y", "x", *[F.col(f).alias(f"_{f}") for f in fields], cell("y").alias("_cy"), cell("x").alias("_cx"))
    near = base.select(*keys, "minute", F.col("y").alias("_cy"), F.col("x").alias("_cx"), *fields)
    innovations = met.join(near, [*keys, "minute", "_cy", "_cx"]).select(*keys, "minute", "y", "x", *[(F.col(f"_{f}") - F.col(f)).alias(f) for f in fields])
    out = interpolate_tiles(innovations, base, [*keys, "minute"], fields, length, ratio, tile, reach, merge)

    def limited(f: str) -> Column:
        low, high = LIMITS.get(f, MOISTURE)
        x = F.col(f) + F.col(f"c_{f}")
        return x if low is None else wx.clip(x, low, high)

    names = [F.col("c_u").alias("u_correction"), F.col("c_v").alias("v_correction"), F.sqrt((F.col("s_u") * F.col("s_u") + F.col("s_v") * F.col("s_v")) / 2).alias("wind_sd")]
    for f in others:
        names += [limited(f).alias(f), F.col(f"s_{f}").alias(f"{f}_sd")]
    out = out.select(*keys, "minute", "y", "x", "speed", F.pmod("direction", F.lit(360.0)).alias("direction"), *names)
    return out.join(counts, [*keys, "minute"], "left").withColumn("station_count", F.coalesce("station_count", F.lit(0)))
