"""Shared working folders: where steps write tables that executors and the driver both see.

The folder is ``spark.checkpoint.dir`` of the session.  Only where that is unset and the master is a
single local JVM (tests) a temporary folder is used; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch sent to Python; texts can be long, so far fewer than Spark's default.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local") and not master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gradus-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Workspace:
    """A fresh subfolder for one operator call, or the folder ``root``."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/gradus-{name}-{uuid.uuid4().hex}"

    def _hadoop(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """What the folder has; nothing if there is none."""
        path, fs = self._hadoop(self.root)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def put(self, name: str, text: str) -> None:
        """Writes a small file, which appears whole or not at all."""
        path, fs = self._hadoop(self.path(name))
        made, _ = self._hadoop(self.path(f".{name}-{uuid.uuid4().hex}"))
        out = fs.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(made, path):
            raise RuntimeError(f"{self.path(name)} can't be written")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and reads it back: cuts the lineage, and lost executors cost no recomputation."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Deletes one table of this workspace (or all of it), once nothing reads it any more."""
        path, fs = self._hadoop(self.path(name) if name else self.root)
        fs.delete(path, True)

    def release_shuffles(self) -> None:
        """Lets Spark's cleaner remove shuffle files of earlier steps that nothing refers to now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for tables of long texts; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
