"""Nearest places in the plane and on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.sources.tables import checkpoint_folder

#: Fixed value: mean radius of the Earth in kilometres.
EARTH_KM = 6371.0088


def _nearest(points: DataFrame, places: DataFrame, point_id: str, place_id: str, axes: list[str], cap: int) -> DataFrame:
    """(point_id, place_id, d2) of each point's nearest place, of equals the lowest id, by squared distance over axes.

    Places are put into cells; a cell with more than `cap` is cut along every axis of the box of its own places, so a
    small spot with most of all places becomes many cells in one step. Points go down from the whole to ever smaller
    cells. At each level a point knows the box of every cell's places: it keeps cells whose box may be nearer than the
    farthest corner of the best box, and drops the others. What is left are few cells of at most `cap` places, however
    dense.
    """
    checkpoint_folder(points.sparkSession)
    cuts = 4 if len(axes) < 3 else 3
    sound = lambda prefix: " and ".join(f"{prefix}{a} is not null and not isnan({prefix}{a})" for a in axes)
    at = places.groupBy(*[F.col(a).cast("double").alias(a) for a in axes]).agg(F.min(place_id).alias(place_id)).filter(sound(""))
    ends = at.agg(*[f(a).alias(f"{s}_{a}") for a in axes for s, f in (("lo", F.min), ("hi", F.max))])
    if ends.filter(F.col(f"lo_{axes[0]}").isNotNull()).isEmpty():
        return points.select(point_id, F.lit(None).cast(places.schema[place_id].dataType).alias(place_id), F.lit(None).cast("double").alias("d2"))
    whole = ends.first().asDict()
    box = [f"{s}_{a}" for a in axes for s in ("lo", "hi")]
    open_ = at.withColumns({"cell": F.lit(""), **{c: F.lit(whole[c]) for c in box}})
    wanted = points.select(point_id, *[F.col(a).cast("double").alias(f"p_{a}") for a in axes]).filter(sound("p_"))
    front, ready, leaves, level = wanted.withColumn("cell", F.lit("")).withColumn("bound", F.lit(float("inf"))), None, None, 0
    while True:
        level += 1
        part = lambda a: F.when(F.col(f"hi_{a}") > F.col(f"lo_{a}"), F.least(F.lit(cuts - 1), F.floor((F.col(a) - F.col(f"lo_{a}")) / (F.col(f"hi_{a}") - F.col(f"lo_{a}")) * cuts))).otherwise(0)
        cells = open_.withColumnRenamed("cell", "parent").withColumn("cell", F.concat(F.col("parent"), F.lit("/"), *[part(a).cast("string") for a in axes])).drop(*box)
        boxes = cells.groupBy("parent", "cell").agg(F.count("*").alias("n"), *[f(a).alias(f"{s}_{a}") for a in axes for s, f in (("lo", F.min), ("hi", F.max))])
        boxes = boxes.withColumn("leaf", F.col("n") <= cap).checkpoint()
        table = F.broadcast(boxes) if cuts ** (len(axes) * level) <= 4096 else boxes  # no more cells than that
        far = sum(F.pow(F.greatest(F.abs(F.col(f"p_{a}") - F.col(f"lo_{a}")), F.abs(F.col(f"p_{a}") - F.col(f"hi_{a}"))), 2) for a in axes)
        near = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"lo_{a}") - F.col(f"p_{a}"), F.col(f"p_{a}") - F.col(f"hi_{a}")), 2) for a in axes)
        met = front.withColumnRenamed("cell", "parent").join(table, "parent").select(point_id, *[f"p_{a}" for a in axes], "cell", "leaf", "bound", near.alias("near"), far.alias("far"))
        both = met if ready is None else met.unionByName(ready)
        bound = F.least("bound", F.min("far").over(Window.partitionBy(point_id)))
        both = both.withColumn("bound", bound).filter("near <= bound * (1 + 1e-12)").checkpoint()
        front, ready = both.filter("not leaf").drop("leaf", "near", "far"), both.filter("leaf")
        split = cells.drop("parent").join(boxes.drop("parent", "n"), "cell")
        done = split.filter("leaf").select("cell", place_id, *axes)
        leaves = done if leaves is None else leaves.union(done)
        if boxes.filter("not leaf").isEmpty():
            break
        open_ = split.filter("not leaf").drop("leaf").checkpoint()
    d2 = sum((F.col(f"p_{a}") - F.col(a)) * (F.col(f"p_{a}") - F.col(a)) for a in axes)
    best = ready.select(point_id, "cell", *[f"p_{a}" for a in axes]).join(leaves, "cell").groupBy(point_id).agg(F.min(F.struct(d2.alias("d2"), F.col(place_id))).alias("m"))
    return best.select(point_id, F.col(f"m.{place_id}").alias(place_id), F.col("m.d2").alias("d2"))


def nearest_point(points: DataFrame, places: DataFrame, point_id: str, place_id: str, cap: int = 64) -> DataFrame:
    """Each point's nearest place (point_id, place_id, distance), of equals the lowest id; both frames have x and y.

    Points have unique ids; one without coordinates has no row; without places, ids and distances are null.
    """
    out = _nearest(points, places, point_id, place_id, ["x", "y"], cap)
    return out.select(point_id, place_id, F.sqrt("d2").alias("distance"))


def _on_sphere(lat: Column, lon: Column) -> dict[str, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return {"_x": F.cos(a) * F.cos(b), "_y": F.cos(a) * F.sin(b), "_z": F.sin(a)}


def nearest_on_sphere(points: DataFrame, places: DataFrame, point_id: str, place_id: str, cap: int = 64) -> DataFrame:
    """Each point's nearest place (point_id, place_id, distance_km) along the great circle, of equals the lowest id.

    Both frames have lat and lon in degrees. Distances are compared as chords between points of the unit sphere, so
    neither the date line nor the poles need care, and a degree of longitude counts by the cosine of its latitude.
    """
    p, q = (x.withColumns(_on_sphere(F.col("lat"), F.col("lon"))) for x in (points, places))
    out = _nearest(p, q, point_id, place_id, ["_x", "_y", "_z"], cap)
    return out.select(point_id, place_id, (2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt("d2") / 2))).alias("distance_km"))
