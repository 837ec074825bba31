"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which the shuffle files of a query go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset in local mode (tests), a new temporary one."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("cinderframe.scratch.dir", "")
    if not found:
        if not (conf.get("spark.master") or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("cinderframe.scratch.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run. A written table ends the lineage: a lost executor costs no recomputation behind it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame, clean: bool = False) -> DataFrame:
        """df as a written table; with clean, its shuffle files go as soon as it is written."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        before = self.spark.conf.get(CLEAN, None)
        if clean:
            self.spark.conf.set(CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            if clean and before is None:
                self.spark.conf.unset(CLEAN)
            elif clean:
                self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(conf).delete(path, True)
