"""Tables published part by part under a manifest, so that a job can be killed anywhere and go on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.sources.tables import digests

#: Column of a stored row: the digest of its keys.
KEY = "_key"


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")


def _names(spark: SparkSession, path: str, folder: str = "") -> set[str]:
    files, at = _files(spark, path)
    where = at(folder)
    return {x.getPath().getName() for x in files.listStatus(where)} if files.exists(where) else set()


def manifest(spark: SparkSession, path: str, contract: str) -> DataFrame | None:
    """(part, file, digest, contract) of every published file; None where nothing is published. A part of another contract is an error."""
    if not _names(spark, path, "_manifest"):
        return None
    m = spark.read.schema("part string, file string, digest string, contract string").json(f"{path}/_manifest/*")
    return m.filter(F.assert_true(F.col("contract") == contract, "a part belongs to another contract").isNull())


def file_changes(spark: SparkSession, path: str, contract: str) -> DataFrame:
    """(part, file, change) of published files that are missing or changed since."""
    m, parts = manifest(spark, path, contract), sorted(_names(spark, path, "_manifest"))
    if m is None:
        return spark.createDataFrame([], "part string, file string, change string")
    there = [p for p in parts if p in _names(spark, path)]
    now = None
    for p in there:
        d = digests(spark, f"{path}/{p}").select(F.lit(p).alias("part"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("digest").alias("now"))
        now = d if now is None else now.union(d)
    now = now if now is not None else spark.createDataFrame([], "part string, file string, now string")
    both = m.join(now, ["part", "file"], "left")
    return both.select("part", "file", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("digest"), "changed").alias("change")).filter("change is not null")


def published(spark: SparkSession, path: str, contract: str, keys: list[str] | None = None) -> DataFrame | None:
    """The rows of all published parts, None where there are none; parts that no manifest names are not read.

    With keys, fails when computed if a row's keys are not those that its digest was made from.
    """
    if manifest(spark, path, contract) is None:
        return None
    rows = spark.read.parquet(*[f"{path}/{p}" for p in sorted(_names(spark, path, "_manifest"))])
    if keys:
        rows = rows.filter(F.assert_true(F.col(KEY) == _digest(keys), "a stored key differs from its digest").isNull())
    return rows


def _digest(keys: list[str]) -> F.Column:
    return F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)


def publish(rows: DataFrame, path: str, keys: list[str], contract: str) -> None:
    """Publish the rows whose keys are not yet published; each key stands once, however often the job is killed and run again.

    Rows are written aside, renamed into place, and count only from the rename of their manifest, which holds the digest of every file.
    What an earlier run left without a manifest is deleted first, so one job may publish at a time. Published files and
    keys are verified before they are relied on. Keys that occur twice in rows are an error.
    """
    spark = rows.sparkSession
    files, at = _files(spark, path)
    done = _names(spark, path, "_manifest")
    for name in _names(spark, path):
        if name.startswith("_staging-") or (name.startswith("part-") and name not in done):
            files.delete(at(name), True)
    fresh = rows.withColumn(KEY, _digest(keys))
    if not fresh.groupBy(KEY).count().filter("count > 1").isEmpty():
        raise ValueError("keys occur twice")
    if done:
        changed = file_changes(spark, path, contract).take(1)
        if changed:
            raise ValueError(f"published file {changed[0].part}/{changed[0].file} is {changed[0].change}")
        fresh = fresh.join(published(spark, path, contract, keys).select(KEY), KEY, "left_anti")
    part = f"part-{uuid.uuid4().hex}"
    staging = f"_staging-{part}"
    fresh.write.parquet(f"{path}/{staging}/data")
    found = digests(spark, f"{path}/{staging}/data").filter("path like '%.parquet'")
    found.select(F.lit(part).alias("part"), F.element_at(F.split("path", "/"), -1).alias("file"), "digest", F.lit(contract).alias("contract")).write.json(f"{path}/{staging}/manifest")
    files.mkdirs(at("_manifest"))
    for source, target in ((f"{staging}/data", part), (f"{staging}/manifest", f"_manifest/{part}")):
        if not files.rename(at(source), at(target)):
            raise OSError(f"{path}/{target} could not be put into place")
    files.delete(at(staging), True)


def index(spark: SparkSession, path: str, contract: str, keys: list[str]) -> DataFrame:
    """(keys, part): where each published key stands. Fails when computed if a key stands twice."""
    rows = published(spark, path, contract, keys).select(*keys, F.element_at(F.split(F.input_file_name(), "/"), -2).alias("part"))
    one = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("part").alias("part"))
    return one.filter(F.assert_true(F.col("_n") == 1, "a key is published twice").isNull()).drop("_n")
