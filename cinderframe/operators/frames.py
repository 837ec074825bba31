"""Frames of cells along time: digests, dormancy, coverage, and areas of unions of polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.operators.statistics import quantiles
from cinderframe.operators.timeseries import overlapping


def digests(cells: DataFrame, keys: list[str], frame: str, cell: list[str]) -> DataFrame:
    """(keys, frame, n_cells, digest) of each frame's set of cells, whatever their order; repeated cells count once.

    The digest adds up the two halves of every cell's 64-bit hash, so parts of a frame are added up where they are.
    Equal frames have equal digests; different ones differ but for about one pair in 2^64.
    """
    h = F.xxhash64(*cell)
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    each = cells.select(*keys, frame, *cell).distinct()
    out = each.groupBy(*keys, frame).agg(F.count("*").alias("n_cells"), F.sum(low).alias("_l"), F.sum(high).alias("_h"))
    return out.select(*keys, frame, "n_cells", F.concat_ws("-", "n_cells", F.hex("_h"), F.hex("_l")).alias("digest"))


def progression(frames: DataFrame, cells: DataFrame, keys: list[str], frame: str, cell: list[str]) -> DataFrame:
    """frames (keys, frame, others) with n_cells, `dormant` (the cells are those of the frame before), `fell` (fewer than in it)
    and `lost` (how many fewer, at least). The first frame of a key is neither; a frame without cells has 0.

    Frames are compared by digest: no cell meets another frame's.
    """
    x = frames.join(digests(cells, keys, frame, cell), [*keys, frame], "left").withColumns({"n_cells": F.coalesce("n_cells", F.lit(0)), "digest": F.coalesce("digest", F.lit("0"))})
    w = Window.partitionBy(*keys).orderBy(frame)
    before, was = F.lag("n_cells").over(w), F.lag("digest").over(w)
    fell = F.coalesce(F.col("n_cells") < before, F.lit(False))
    return x.withColumns({"dormant": F.coalesce(F.col("digest") == was, F.lit(False)), "fell": fell, "lost": F.when(fell, before - F.col("n_cells")).otherwise(0)}).drop("digest")


def progression_audit(frames: DataFrame, keys: list[str], frame: str, reported: str, cell_area: float) -> DataFrame:
    """Per key of progression(): frames, those with cells, dormant ones and ones that fell, the greatest loss, and the
    least, median, greatest and last share of the reported area that the cells cover (of frames that report one)."""
    x = frames.withColumn("_c", F.when(F.col(reported) > 0, F.col("n_cells") * cell_area / F.col(reported)))
    out = x.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), F.count_if(F.col("n_cells") > 0).alias("n_filled"), F.count_if("dormant").alias("n_dormant"), F.count_if("fell").alias("n_fell"), F.max("lost").alias("most_lost"),
        F.min("_c").alias("least_covered"), F.max("_c").alias("most_covered"), F.max_by("_c", frame).alias("last_covered"),
    )
    return out.join(quantiles(x, keys, "_c", {"median_covered": 0.5}), keys, "left")


def area_means(frames: DataFrame, keys: list[str], area: str) -> DataFrame:
    """Per key, p10, p50 and p90, mean, least and greatest of members' areas."""
    plain = frames.groupBy(*keys).agg(F.avg(area).alias("mean"), F.min(area).alias("least"), F.max(area).alias("most"))
    return plain.join(quantiles(frames, keys, area, {"p10": 0.1, "p50": 0.5, "p90": 0.9}), keys)


def _edges(polygons: DataFrame, keys: list[str], polygon: str) -> DataFrame:
    """(keys, id, y0, y1, x0, dx) of the edges that are not level, upwards: x = x0 + dx * (y - y0)."""
    p = F.col(polygon)
    sides = F.transform(p, lambda q, i: F.struct(F.element_at(p, F.when(i == 0, -1).otherwise(i)).alias("a"), q.alias("b")))
    e = polygons.withColumn("_id", F.monotonically_increasing_id()).select(*keys, "_id", F.explode(sides).alias("e")).filter("e.a.y <> e.b.y")
    up = F.col("e.a.y") < F.col("e.b.y")
    e = e.select(*keys, "_id", F.when(up, F.col("e.a")).otherwise(F.col("e.b")).alias("a"), F.when(up, F.col("e.b")).otherwise(F.col("e.a")).alias("b"))
    return e.select(*keys, "_id", F.col("a.y").alias("y0"), F.col("b.y").alias("y1"), F.col("a.x").alias("x0"), ((F.col("b.x") - F.col("a.x")) / (F.col("b.y") - F.col("a.y"))).alias("dx"))


def _at(e: str, y: Column) -> Column:
    return F.col(f"{e}.x0") + F.col(f"{e}.dx") * (y - F.col(f"{e}.y0"))


def union_area(polygons: DataFrame, keys: list[str], polygon: str, height: float) -> DataFrame:
    """(keys, area) of the union of all polygons of a key (arrays of (x, y), even-odd inside), however they overlap.

    The plane is cut into slabs at every corner and every crossing of two edges, so inside a slab no edges cross
    and the union's width changes evenly: its area is its width halfway up times its height. In a slab each polygon
    is a few intervals, and overlapping intervals of all polygons are merged as gaps and islands. Edges meet
    each other and slabs in bands of `height`, about the usual height of an edge. Polygons of no area give none, and equal
    ones, which cover what one covers, are taken once.
    """
    e = _edges(polygons.select(*keys, polygon).distinct(), keys, polygon)
    met = overlapping(e, e, keys, "y0", "y1", height).filter("l.dx < r.dx")
    y = (F.col("r.x0") - F.col("r.dx") * F.col("r.y0") - F.col("l.x0") + F.col("l.dx") * F.col("l.y0")) / (F.col("l.dx") - F.col("r.dx"))
    inside = (y > F.greatest("l.y0", "r.y0")) & (y < F.least("l.y1", "r.y1"))
    crossings = met.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.when(inside, y).alias("y")).filter("y is not null")
    levels = e.select(*keys, F.explode(F.array("y0", "y1")).alias("y")).union(crossings).distinct()
    slabs = levels.select(*keys, F.col("y").alias("y0"), F.lead("y").over(Window.partitionBy(*keys).orderBy("y")).alias("y1")).filter("y1 is not null")
    cut = overlapping(slabs, e, keys, "y0", "y1", height)
    cut = cut.select(*[F.col(f"l.{k}").alias(k) for k in keys], F.col("l.y0").alias("y0"), F.col("l.y1").alias("y1"), F.col("r._id").alias("id"), _at("r", (F.col("l.y0") + F.col("l.y1")) / 2).alias("x"))
    own = Window.partitionBy(*keys, "y0", "id").orderBy("x")
    spans = cut.withColumns({"n": F.row_number().over(own), "end": F.lead("x").over(own)}).filter("n % 2 = 1")
    row = Window.partitionBy(*keys, "y0").orderBy("x", "end")
    spans = spans.withColumn("far", F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("new", F.greatest(F.lit(0.0), F.col("end") - F.greatest("x", F.coalesce("far", "x"))))
    return spans.groupBy(*keys).agg(F.sum(F.col("new") * (F.col("y1") - F.col("y0"))).alias("area"))


def area_ratios(cells: DataFrame, polygons: DataFrame, keys: list[str], polygon: str, cell_area: float, height: float) -> DataFrame:
    """(keys, ratio): area of a key's cells over that of the union of its polygons."""
    raster = cells.groupBy(*keys).agg((F.count("*") * cell_area).alias("_r"))
    return union_area(polygons, keys, polygon, height).join(raster, keys, "left").select(*keys, "area", (F.coalesce("_r", F.lit(0.0)) / F.col("area")).alias("ratio"))


def radial_errors(cells: DataFrame, keys: list[str], cell: float, expected: Column) -> DataFrame:
    """Per key of a front that grew from the origin (y, x in cells): its equivalent radius, greatest radius, and how far each is
    from the expected one, an expression over keys."""
    r = F.hypot(F.col("y") * cell, F.col("x") * cell)
    out = cells.groupBy(*keys).agg(F.sqrt(F.count("*") * cell * cell / F.pi()).alias("equivalent_radius"), F.max(r).alias("greatest_radius"))
    return out.withColumns({"equivalent_error": F.abs(F.col("equivalent_radius") - expected), "greatest_error": F.abs(F.col("greatest_radius") - expected)})


def case_atlas(cells: DataFrame, case: str, moment: str, area: float, values: list[str]) -> DataFrame:
    """Per case and moment: area of its cells, mean and greatest of each value, and growth of the area since the moment before."""
    out = cells.groupBy(case, moment).agg((F.count("*") * area).alias("area"), *[f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("most", F.max))])
    return out.withColumn("growth", F.col("area") - F.coalesce(F.lag("area").over(Window.partitionBy(case).orderBy(moment)), F.lit(0.0)))


def rotation_spread(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Per group over its headings, the coefficient of variation (population) of each value."""
    return rows.groupBy(*by).agg(*[(F.stddev_pop(v) / F.avg(v)).alias(f"{v}_spread") for v in values])


def fractions(cells: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Per group, the share of cells for which each flag holds."""
    return cells.groupBy(*by).agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in flags.items()])
