"""What the training-data operators share: table access, a shared scratch folder, and worker-side caches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches carry whole texts, so they are bounded by bytes as well as by rows.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
#: Bits of a map of digests: 8 MB at most.
BITS = 1 << 26
#: Module that holds a Python process's caches.
STORE = "_training_data_cache"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; also bounds the Arrow batches that the session sends to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def worker_cache(key: Any, build: Callable[[], Any]) -> Any:
    """build() once for each Python process. Functions sent by value have no globals in common, so a module holds it."""
    store = sys.modules.setdefault(STORE, types.ModuleType(STORE)).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def forget() -> None:
    """Drops what other operators' tasks have cached in this Python process, which Spark uses again for task after task."""
    store = sys.modules.get(STORE)
    if store is not None and any(isinstance(key, tuple) for key in store.__dict__):
        for key in [k for k in store.__dict__ if isinstance(k, tuple)]:
            del store.__dict__[key]
    release()


def release() -> None:
    """Gives memory that this Python process has freed back to the system, where the C library can."""
    gc.collect()
    trim()


def trim() -> None:
    """The same without a search for cycles: cheap enough for every batch. Arrow's pool would keep a few batches' size else."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def maybe_among(digest: Column, digests: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds the column maybe to rows: whether their digest can be among digests. Never wrong if it says no.

    A bitmap of BITS bits, in rows of 4 KB: of digests as many as bits it says maybe to all, and is still right.
    """
    place = lambda d: F.pmod(F.xxhash64(d), F.lit(BITS))
    bits = digests.select(place(F.col("digest")).alias("place"))
    bitmap = bits.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))

    def mark(rows: DataFrame) -> DataFrame:
        at = F.bitmap_bit_position(place(digest))
        byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
        return rows.withColumn("bucket", F.bitmap_bucket_number(place(digest))).join(F.broadcast(bitmap), "bucket", "left").withColumn("maybe", hit).drop("bucket", "bits")

    return mark


class Workspace:
    """Tables written to the folder in spark.checkpoint.dir, which driver and executors share.

    Reading a written table cuts lineage, and survives the loss of any executor. ``drop`` removes a table that is no
    longer read; the rest goes when the driver ends. Without the setting a temporary folder is used on a local master
    only, since on a cluster nobody else would see it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = f"file://{tempfile.gettempdir()}/checkpoints"
        self.root = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        """df, written as Parquet and read again."""
        path = self.path(name)
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._workspace_path = path  # noqa: SLF001
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            remove(self.spark, df._workspace_path)  # noqa: SLF001

    def clear(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended, and with it the means to delete
            pass


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)  # noqa: SLF001
