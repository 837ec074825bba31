"""Readers that turn files of incident data into DataFrames, and writers of replay and digest tables."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Columns of a landscape cell: the first four are required, others are null where a file lacks them.
LANDSCAPE = {"elevation_m": "float", "fuel_load_kg_m2": "float", "barrier": "boolean", "asset_value": "float", "fuel_model_number": "smallint", "canopy_cover": "float", "canopy_height_m": "float", "canopy_base_height_m": "float", "canopy_bulk_density_kg_m3": "float"}
REQUIRED = tuple(LANDSCAPE)[:4]


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with np.load(io.BytesIO(content), allow_pickle=False) as z:
                missing = [c for c in REQUIRED if c not in z]
                if missing:
                    raise ValueError(f"{path}: no {', '.join(missing)}")
                shape = z[REQUIRED[0]].shape
                if any(z[c].shape != shape for c in LANDSCAPE if c in z):
                    raise ValueError(f"{path}: rasters differ in shape")
                for y in range(shape[0]):  # a grid row at a time keeps batches small
                    row = {"path": path, "y": y, "x": np.arange(shape[1])}
                    yield pd.DataFrame(row | {c: z[c][y] if c in z else None for c in LANDSCAPE})


def read_landscapes(spark: SparkSession, path: str) -> DataFrame:
    """Cells (path, y, x, rasters) of NPZ landscapes; a file is decoded in one task."""
    kinds = "path string, y int, x int, " + ", ".join(f"{c} {t}" for c, t in LANDSCAPE.items())
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInPandas(_cells, kinds)


def landscape_rules() -> dict[str, Column]:
    """Rules of a valid landscape cell, for audit.violations."""
    return {"elevation": ~F.isnan("elevation_m"), "fuel_load": F.col("fuel_load_kg_m2") >= 0, "asset": F.col("asset_value") >= 0, "canopy": F.coalesce(F.col("canopy_cover").between(0, 1), F.lit(True))}


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections: path, properties (string map), geometry (JSON text)."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "type string, features array<struct<properties: map<string,string>, geometry: string>>").alias("d"))
    return docs.filter("d.type = 'FeatureCollection'").select("path", F.explode("d.features").alias("f")).select("path", "f.properties", "f.geometry")


def bounding_box(geometry: Column) -> Column:
    """(west, south, east, north) of the numbers in a geometry's coordinates, which come in pairs."""
    numbers = F.transform(F.regexp_extract_all(geometry, F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(1)), lambda x: x.cast("double"))
    other = F.transform(F.regexp_extract_all(geometry, F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(2)), lambda x: x.cast("double"))
    return F.array(F.array_min(numbers), F.array_min(other), F.array_max(numbers), F.array_max(other))


def read_items(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Assets of item documents {id, properties, assets: {name: {href}}}, one a file (or a line): path, item_id, properties, asset,
    href."""
    kind = "id string, properties map<string,string>, assets map<string, struct<href: string>>"
    docs = spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("path"), F.from_json("value", kind).alias("d"))
    out = docs.select("path", F.col("d.id").alias("item_id"), "d.properties", F.explode("d.assets").alias("asset", "link"))
    return out.select("path", "item_id", "properties", "asset", F.col("link.href").alias("href"))


def asset_status(items: DataFrame, files: DataFrame) -> DataFrame:
    """items with `status`: escapes, where href leaves the item's folder, missing, where no file (path relative to the folder) has
    its name, else found."""
    depth = F.aggregate(F.split("href", "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a.d + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"), F.least(a.low, a.d + F.when(p == "..", -1).otherwise(0)).alias("low")), lambda a: a.low)
    leaves = F.coalesce(F.startswith("href", F.lit("/")) | F.contains("href", F.lit("://")) | (depth < 0), F.lit(True))
    found = items.join(files.select(F.col("path").alias("href"), F.lit(True).alias("_f")).distinct(), "href", "left")
    return found.select(*items.columns, F.when(leaves, "escapes").when(F.col("_f"), "found").otherwise("missing").alias("status"))


def write_landscape(cells: DataFrame, path: str) -> None:
    """Cells with the rasters' types as Parquet, by path; rasters that are not there are null."""
    have = set(cells.columns)
    cells.select("path", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in LANDSCAPE.items()]).write.partitionBy("path").parquet(path)


def read_hourly(spark: SparkSession, path: str, fields: list[str], fill: float = -999.0) -> DataFrame:
    """Hours that all series of JSON payloads {field: {yyyymmddHH: value}} have, without those that hold the fill value."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "map<string, map<string, double>>").alias("d"))
    out = docs.select("path", F.explode(F.element_at("d", fields[0])).alias("hour", fields[0]))
    for field in fields[1:]:
        out = out.join(docs.select("path", F.explode(F.element_at("d", field)).alias("hour", field)), ["path", "hour"])
    for field in fields:
        out = out.filter(F.col(field) > fill)
    return out.withColumn("valid", F.to_timestamp("hour", "yyyyMMddHH"))


def read_surfaces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Performance surfaces from JSON documents: (surface, altitude, load, true_airspeed_m_s, endurance_multiplier) for
    every corner, and (surface, altitude, maximum_payload_fraction); surface is the source that a document names.

    A document of another version, without a source, with axes that are short or do not rise, with loads outside 0
    to 1, with tables of another shape, or with values that are not positive (payloads above 1) is an error.
    """
    axis, table = "array<double>", "array<array<double>>"
    kind = f"schema_version int, density_altitude_m {axis}, payload_fraction {axis}, true_airspeed_m_s {table}, endurance_multiplier {table}, maximum_payload_fraction {axis}, metadata map<string,string>"
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", kind).alias("d")).select("path", "d.*")
    a, b, top = F.col("density_altitude_m"), F.col("payload_fraction"), F.col("maximum_payload_fraction")
    rises = lambda x: (F.size(x) >= 2) & F.forall(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))), lambda i: F.get(x, i) > F.get(x, i - 1))
    good = lambda v: v.isNotNull() & (v > 0) & (v < float("inf"))
    full = lambda t: (F.size(t) == F.size(a)) & F.forall(t, lambda r: (F.size(r) == F.size(b)) & F.forall(r, good))
    source = F.trim(F.element_at("metadata", "source"))
    rules = {
        "version": F.col("schema_version") == 1, "source": source != "", "axes": rises(a) & rises(b) & (b[0] >= 0) & (F.element_at(b, -1) <= 1),
        "tables": full(F.col("true_airspeed_m_s")) & full(F.col("endurance_multiplier")), "payload": (F.size(top) == F.size(a)) & F.forall(top, lambda v: good(v) & (v <= 1)),
    }
    broken = F.array_join(F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]), lambda x: x.isNotNull()), ", ")
    d = d.withColumn("surface", F.when(broken != "", F.raise_error(F.concat("path", F.lit(" breaks rules: "), broken)).cast("string")).otherwise(source))
    rows = d.select("surface", "payload_fraction", "endurance_multiplier", "true_airspeed_m_s", "maximum_payload_fraction", F.posexplode("density_altitude_m").alias("i", "altitude"))
    corners = rows.select("surface", "altitude", F.get("true_airspeed_m_s", F.col("i")).alias("speed"), F.get("endurance_multiplier", F.col("i")).alias("more"), F.posexplode("payload_fraction").alias("j", "load"))
    corners = corners.select("surface", "altitude", "load", F.get("speed", F.col("j")).alias("true_airspeed_m_s"), F.get("more", F.col("j")).alias("endurance_multiplier"))
    return corners, rows.select("surface", "altitude", F.get("maximum_payload_fraction", F.col("i")).alias("maximum_payload_fraction"))


def read_catalog(text: str) -> dict:
    """A JSON object in which no key may occur twice."""
    def unique(pairs: list[tuple[str, object]]) -> dict:
        names = [k for k, _ in pairs]
        again = {k for k in names if names.count(k) > 1}
        if again:
            raise ValueError(f"keys occur twice: {', '.join(sorted(again))}")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=unique)


def _twice(text: str | None) -> str | None:
    found: set[str] = set()

    def note(pairs: list[tuple[str, object]]) -> None:
        names = [k for k, _ in pairs]
        found.update(k for k in names if names.count(k) > 1)

    if text is None:
        return None
    json.loads(text, object_pairs_hook=note)
    return ", ".join(sorted(found))


def repeated_names(text: Column) -> Column:
    """The keys that occur twice in an object of a JSON document, at any depth, in order; empty where none does."""
    return F.pandas_udf(lambda s: s.map(_twice), "string")(text)


def read_registries(spark: SparkSession, path: str, lines: bool = False, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Evidence registries, a JSON document a file (or a line): documents (registry_id and their fields), and evidence
    (registry_id, profile_id, position, domain, status, evidence_grade, applicability, finding, document_ids). Another version of the
    schema is an error when computed; operators.service.registry_faults() finds what does not fit together."""
    field = "status string, evidence_grade string, applicability string, finding string, document_ids array<string>"
    kind = f"schema_version int, registry_id string, researched_at string, documents array<struct<document_id: string, title: string, publisher: string, issued: string, url: string, document_class: string, sha256: string>>, profiles array<struct<profile_id: string, domains: map<string, struct<{', '.join(f.replace(' ', ': ', 1) for f in field.split(', '))}>>>>"
    d = spark.read.text(path, wholetext=not lines).select(F.from_json("value", kind).alias("d")).select("d.*")
    d = d.filter(F.assert_true(F.coalesce(F.col("schema_version") == version, F.lit(False)), "unsupported version").isNull())
    documents = d.select("registry_id", F.explode("documents").alias("x")).select("registry_id", "x.*")
    profiles = d.select("registry_id", F.posexplode("profiles").alias("position", "p"))
    evidence = profiles.select("registry_id", "p.profile_id", "position", F.explode("p.domains").alias("domain", "e"))
    return documents, evidence.select("registry_id", "profile_id", "position", "domain", "e.*")


def read_sites(spark: SparkSession, path: str, crs: str, affine: tuple[float, ...], verified: bool = True) -> DataFrame:
    """Service sites (site_id, x, y, services) of GeoJSON collections of points, as columns and rows of a grid (rounded halves to
    even). A collection that names another CRS is an error; with verified, sites not marked so are left out, and an
    empty result is the reader's to judge."""
    kind = "type string, crs struct<properties: struct<name: string>>, features array<struct<properties: struct<site_id: string, services: array<string>, verification: string>, geometry: struct<type: string, coordinates: array<double>>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d")).select("d.*")
    d = d.filter(F.assert_true(F.col("type") == "FeatureCollection", "not a FeatureCollection").isNull())
    d = d.filter(F.assert_true(F.coalesce(F.col("crs.properties.name"), F.lit(crs)) == crs, "the CRS differs").isNull())
    f = d.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry").filter("geometry.type = 'Point'")
    if verified:
        f = f.filter("verification = 'manually_verified'")
    a, b, c, e, g, h = affine
    det = a * g - b * e
    px, py = F.col("geometry.coordinates")[0] - c, F.col("geometry.coordinates")[1] - h
    return f.select("site_id", F.bround((g * px - b * py) / det, 0).cast("int").alias("x"), F.bround((a * py - e * px) / det, 0).cast("int").alias("y"), "services")


def read_replay(spark: SparkSession, path: str, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Frames of a replay written by write_replay(). Fails when computed if its version is not one of these, or if it does not
    have as many frames as its metadata says."""
    meta = spark.read.schema("schema_version int, frame_count long, digest string").json(f"{path}/metadata.json")
    frames = spark.read.parquet(f"{path}/frames")
    n = frames.agg(F.countDistinct("minute").alias("_n"))
    ok = meta.crossJoin(n).filter(F.assert_true(F.col("schema_version").isin(*versions), "unsupported version").isNull() & F.assert_true(F.col("_n") == F.col("frame_count"), "frames are missing").isNull())  # one row each
    return frames.join(F.broadcast(ok.select("schema_version")), F.lit(True))


def write_replay(frames: DataFrame, path: str, version: int = 1) -> None:
    """Frames (minute and others) as Parquet, and metadata with the version, the number of frames and a digest of all rows."""
    frames.write.parquet(f"{path}/frames")
    back = frames.sparkSession.read.parquet(f"{path}/frames")
    h = F.xxhash64(*back.columns)
    meta = back.agg(F.lit(version).alias("schema_version"), F.countDistinct("minute").alias("frame_count"), F.concat_ws("-", F.hex(F.sum(F.shiftrightunsigned(h, 32))), F.hex(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))))).alias("digest"))
    meta.write.json(f"{path}/metadata.json")


def append_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("digest"))


def write_events(events: DataFrame, path: str, payload: list[str]) -> None:
    """Append an event log: minute, kind and the payload as JSON, by episode."""
    events.select("episode_id", "minute", "kind", F.to_json(F.struct(*payload)).alias("payload_json")).write.mode("append").partitionBy("episode_id").parquet(path)


def read_events(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """The event log with its payload read by a schema."""
    return spark.read.parquet(path).withColumn("payload", F.from_json("payload_json", payload))


def write_missing(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table at path does not hold, so that a job can go on where it stopped."""
    spark = rows.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def checkpoint_folder(spark: SparkSession) -> None:
    """Set a folder for checkpoint() where the session has none: on a cluster spark.checkpoint.dir names it."""
    import tempfile

    conf = spark.sparkContext.getConf()
    if not conf.get("spark.checkpoint.dir") and not (conf.get("spark.master") or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf.get("spark.checkpoint.dir") and spark._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
