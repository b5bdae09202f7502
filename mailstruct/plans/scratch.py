"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Tables written as Parquet under spark.checkpoint.dir and read again, so lineage ends there and a lost executor costs nothing.

    clear() removes them; so does the driver's end. Without the setting a temporary folder serves on a local master only.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = f"file://{tempfile.gettempdir()}/checkpoints"
        self.spark, self.root = spark, f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)  # noqa: SLF001
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001
        except Exception:  # noqa: BLE001  the session has ended, and with it the means to delete
            pass


def file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    store, there = file_system(spark, path)
    return store.exists(there)


def delete(spark: SparkSession, path: str) -> None:
    store, there = file_system(spark, path)
    store.delete(there, True)
