"""What was seen before, over runs and streams: each content is kept once, whenever it comes again.

`SeenSet` is a table of digests by run, behind a blocked Bloom filter. A run's rows meet the filter first: what it says no to is
new, and only the rest, which are repeats and a few false alarms, is looked up in the table. `first_seen` does the same for a stream with
a state for each digest, which may be forgotten after a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from mailstruct.plans.scratch import delete, exists

#: Bits of a row of the filter (what Spark's bitmap functions give), bits set for a key, and keys that a row is sized for: 12 bits each.
BLOCK, HASHES, KEYS = 32768, 4, 2730
#: Rows of the filter and digests that may be sent to all tasks: 40 MB and a few MB.
FILTER_ROWS, LOOKED_UP = 10_000, 100_000


def places(digest: Column, blocks: int) -> tuple[Column, Column]:
    """(row of the filter, positions in it) of a digest."""
    own = F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda i: F.pmod(F.xxhash64(digest, i), F.lit(BLOCK)).cast("int"))
    return F.pmod(F.xxhash64(digest), F.lit(blocks)), own


def filter_of(digests: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): a blocked Bloom filter of digests, as rows of 4 KB. A block without keys has no row."""
    block, own = places(F.col("digest"), blocks)
    set_bits = digests.select(block.alias("block"), F.explode(own).alias("at"))
    return set_bits.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def may_contain(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """rows with the column maybe: false is certain."""
    block, own = places(F.col("digest"), blocks)
    marked = rows.withColumn("_block", block).join(bloom.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")), "_block", "left")
    byte = lambda at: F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    all_set = F.forall(own, lambda at: F.getbit(byte(at), at % 8) == 1)
    return marked.withColumn("maybe", F.col("_bits").isNotNull() & F.coalesce(all_set, F.lit(False))).drop("_block", "_bits")


class SeenSet:
    """Digests that earlier runs kept, below a folder that driver and executors share.

    runs/run=<name>: (digest, at), one folder a run; a run that is done again under its name replaces what it wrote and doesn't see it,
    so a run that failed half way is simply repeated. ttl_days: digests kept longer ago than that, by the run's time, count as unseen.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_days: int | None = None):
        self.spark, self.path, self.ttl_days = spark, path.rstrip("/"), ttl_days

    def known(self, run: str | None = None, at: datetime | None = None) -> DataFrame:
        """(digest, at, run) that a run at that time must take as seen."""
        if not exists(self.spark, f"{self.path}/runs"):
            return self.spark.createDataFrame([], "digest binary, at timestamp, run string")
        rows = self.spark.read.schema("digest binary, at timestamp, run string").option("basePath", f"{self.path}/runs").parquet(f"{self.path}/runs")
        if run is not None:
            rows = rows.where(F.col("run") != run)
        if self.ttl_days is not None and at is not None:
            rows = rows.where(F.col("at") > F.lit(at) - F.expr(f"INTERVAL '{self.ttl_days}' DAY"))
        return rows

    def keep_new(self, rows: DataFrame, digest: Column, order: list, run: str, at: datetime) -> DataFrame:
        """The rows of a run whose digest no other run has kept, the first of each in the given order, which must tell them apart.

        A null digest is never a repeat: such rows all stay. Times of the rows play no part, so there are no late rows: what comes in
        a later run is a repeat, however old it says it is. The rows are read twice.
        """
        keyed = rows.withColumn("digest", digest)
        mine = keyed.where("digest is not null").select("digest").distinct()
        known = self.known(run, at)
        n = known.count()
        new = mine
        if n:
            blocks = max(1, -(-n // KEYS))
            bloom = filter_of(known, blocks)
            bloom = F.broadcast(bloom) if blocks <= FILTER_ROWS else bloom
            asked = self.write(may_contain(mine, bloom, blocks), f"asked/{run}")
            maybe = asked.where("maybe").select("digest")
            # repeats, and one in some hundreds of the others
            few = maybe.count() <= LOOKED_UP
            met = known.select("digest").join(F.broadcast(maybe) if few else maybe, "digest", "left_semi").distinct()
            new = asked.where("not maybe").select("digest").unionAll(maybe.join(met, "digest", "left_anti"))
        kept = self.write(new.select("digest", F.lit(at).cast("timestamp").alias("at")), f"runs/run={run}")
        delete(self.spark, f"{self.path}/asked/{run}")
        first = keyed.where("digest is not null").withColumn("_place", F.row_number().over(Window.partitionBy("digest").orderBy(*order))).where("_place = 1").drop("_place")
        return first.join(kept.select("digest"), "digest", "left_semi").select(*keyed.columns).unionAll(keyed.where("digest is null"))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def expire(self, at: datetime) -> list[str]:
        """Removes runs of which every digest is older than the time to live; gives their names."""
        if self.ttl_days is None:
            return []
        old = self.known().groupBy("run").agg(F.max("at").alias("last")).where(F.col("last") <= F.lit(at) - F.expr(f"INTERVAL '{self.ttl_days}' DAY"))
        names = sorted(r.run for r in old.collect())  # a row for each run
        for name in names:
            delete(self.spark, f"{self.path}/runs/run={name}")
        return names


class FirstSeen(StatefulProcessor):
    """The first row of each digest, and none of it again before its state has expired."""

    def __init__(self, order: list[str], ttl_ms: int | None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at timestamp", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        if self.seen.exists():
            return
        place = lambda r: tuple((r[c] is not None, r[c]) for c in self.order)
        first = min(rows, key=place)
        self.seen.update((datetime.now(),))
        yield first

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:  # noqa: N802, N803
        self.seen.update((initialState["at"],))


#: Rows that a task gathers before it reduces them to the first of each digest.
GATHERED = 200_000


def firsts(rows: pa.Table, order: list[str]) -> pa.Table:
    """The first row of each digest in the given order, nulls first."""
    at = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("digest", *order)], null_placement="at_start")
    rows = rows.take(at)
    if rows.num_rows < 2:
        return rows
    code = rows.column("digest").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return rows.filter(pa.array(np.concatenate(([True], code[1:] != code[:-1]))))


def first_of_task(order: list[str], whole: bool = True):
    """The first row of each digest of a task, or, unless whole, of each stretch of it: then many copies move as few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, GATHERED
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                held = firsts(pa.Table.from_batches(held), order).to_batches()
                if not whole:
                    yield from held
                    held = []
                n = sum(b.num_rows for b in held)
                most = 2 * n + GATHERED
        if held:
            yield from firsts(pa.Table.from_batches(held), order).to_batches()

    return run


def first_seen(rows: DataFrame, order: list[str], ttl_ms: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """A stream of rows (digest, ...) without those whose digest came before; within a batch the first in the given order stays.

    seen: (digest, at) of a SeenSet, taken as having come before the stream began. Arrival decides: there is no watermark, so no row
    is too late, and a digest that comes again after ttl_ms by the clock is new. Rows with a null digest are one group like any other.
    Call use_rocksdb before.

    With neither a time to live nor a start, Spark's own state of duplicates serves, once each batch holds one row of a digest: a task
    holds its digests of one batch. Else a processor keeps the state, and asks for it by a call for each digest.
    """
    if ttl_ms is None and seen is None:
        few = rows.mapInArrow(first_of_task(order, whole=False), rows.schema)
        return few.repartition("digest").mapInArrow(first_of_task(order), rows.schema).dropDuplicates(["digest"])
    schema = StructType(rows.schema.fields)
    start = None if seen is None else seen.groupBy("digest").agg(F.max("at").alias("at")).groupBy("digest")
    return rows.groupBy("digest").transformWithState(FirstSeen(order, ttl_ms), schema, "append", "none" if ttl_ms is None else "processingTime", initialState=start)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that first_seen needs. Batches without data go: with a time to live a stream over what is available would never end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
