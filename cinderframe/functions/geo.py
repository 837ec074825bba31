"""Column builders for coordinates, grids, labels and simple geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Fixed value: radius of the sphere of Web Mercator, in metres.
MERCATOR_RADIUS = 6378137.0


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_RADIUS, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * MERCATOR_RADIUS


def mercator_scale(lat: Column) -> Column:
    """Metres on the ground per metre of Web Mercator."""
    return F.cos(F.radians(lat))


#: Codes of Web Mercator, and ranges of codes whose axes are metres on a projected grid: UTM (WGS 84 north and
#: south, NAD 83), the North American Albers grids and the conterminous one.
WEB_MERCATOR = (3857, 3785, 900913, 102100, 102113)
METRIC = ((32601, 32660), (32701, 32760), (26901, 26923), (5070, 5072), (3338, 3338))


def metric_suitability(epsg: Column, lat: Column) -> Column:
    """Struct of whether map units are metres on the ground: web_mercator, metric, metres and area on the ground per unit of
    the map (Web Mercator only) and reason, null if metric. Codes beyond METRIC, and null, are not taken to be metric."""
    web = F.coalesce(epsg.isin(*WEB_MERCATOR), F.lit(False))
    metric = F.lit(False)
    for low, high in METRIC:
        metric = metric | F.coalesce(epsg.between(low, high), F.lit(False))
    scale = F.when(web, mercator_scale(lat))
    reason = F.when(web, "scale varies with latitude").when(~metric, "no projected grid in metres")
    return F.struct(web.alias("web_mercator"), metric.alias("metric"), scale.alias("scale"), (scale * scale).alias("area_scale"), reason.alias("reason"))


def utm_zone(lon: Column) -> Column:
    return (F.least(F.lit(59), F.floor((lon + 180) / 6)) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def cell_centre(x: Column, y: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    """World coordinates of a cell's centre under (a, b, c, d, e, f)."""
    a, b, c, d, e, f = affine
    return a * (x + 0.5) + b * (y + 0.5) + c, d * (x + 0.5) + e * (y + 0.5) + f


def cell_of(wx: Column, wy: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    """Column and row of the cell that holds a world coordinate."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    return F.floor((e * (wx - c) - b * (wy - f)) / det), F.floor((-d * (wx - c) + a * (wy - f)) / det)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def state_prefix(name: Column) -> Column:
    """Two capital letters before - or _, else UNKNOWN."""
    found = F.regexp_extract(name, "^([A-Z]{2})[-_]", 1)
    return F.when(found != "", found).otherwise("UNKNOWN")


def whole_minutes(seconds: Column) -> Column:
    """Minutes, halves to even, at least one."""
    return F.greatest(F.lit(1), F.bround(seconds / 60.0, 0).cast("long"))


def equivalent_radius(n_cells: Column, cell: float) -> Column:
    return F.sqrt(n_cells * cell * cell / F.pi())


def radius_rate(before: Column, now: Column, minutes: Column, cell: float) -> Column:
    """Growth of the equivalent radius, by cells, in metres a minute; a fall is none. Null where no time has passed or a count is null."""
    grown = equivalent_radius(now, cell) - equivalent_radius(before, cell)
    return F.when((minutes > 0) & grown.isNotNull(), F.greatest(F.lit(0.0), grown) / minutes)


def clock_label(origin: Column, minute: Column) -> Column:
    """ISO time, to the minute, of a minute after the origin; without one, minutes elapsed."""
    at = F.timestamp_micros(F.unix_micros(origin) + minute.cast("long") * 60_000_000)
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mmxxx"), F.concat(F.lit("T+"), F.when(minute.between(0, 99), F.lpad(minute.cast("string"), 3, "0")).otherwise(minute.cast("string")), F.lit(" min")))


def scale_length(span: Column) -> Column:
    """The greatest of 1, 2 and 5 times a power of ten that is at most a quarter of span."""
    q = span / 4
    p = F.pow(F.lit(10.0), F.floor(F.log10(q)))
    return F.when(q >= 5 * p, 5 * p).when(q >= 2 * p, 2 * p).otherwise(p)


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a polygon: a ray to the right crosses its edges an odd number of times."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y0 != y1:
            straddles = (F.lit(y0) > y) != (F.lit(y1) > y)
            crossings += F.when(straddles & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0), 1).otherwise(0)
    return crossings % 2 == 1


def table_lookup(x: Column, axis: list[float], values: list[float]) -> Column:
    """Linear interpolation in a short table, clamped at its ends."""
    out = F.when(x <= axis[0], F.lit(values[0]))
    for a, b, u, v in zip(axis, axis[1:], values, values[1:], strict=False):
        out = out.when(x <= b, u + (x - a) / (b - a) * (v - u))
    return out.otherwise(F.lit(values[-1]))
