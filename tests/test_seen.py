"""Seen sets over runs and streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailstruct.operators import seen

NOW = datetime(2024, 1, 1)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "idx long, content string, digest_of string").repartition(3)


def keep(store, rows, run, at=NOW):
    return sorted(r.idx for r in store.keep_new(rows, F.sha2("content", 256).cast("binary"), ["idx"], run, at).collect())


def test_a_later_run_drops_what_an_earlier_one_kept(spark, tmp_path):
    store = seen.SeenSet(spark, f"file://{tmp_path}")
    assert keep(store, rows_of(spark, [(1, "a", ""), (2, "b", ""), (3, "a", ""), (4, None, ""), (5, None, "")]), "r1") == [1, 2, 4, 5]
    assert keep(store, rows_of(spark, [(6, "b", ""), (7, "c", ""), (8, "c", ""), (9, None, "")]), "r2") == [7, 9]
    # the same run again, as after a failure: its own digests don't count, those of others do
    assert keep(store, rows_of(spark, [(6, "b", ""), (7, "c", ""), (8, "d", "")]), "r2") == [7, 8]
    assert keep(store, rows_of(spark, [(10, "a", ""), (11, "d", "")]), "r3") == []
    assert keep(store, rows_of(spark, []), "r4") == []
    assert store.known().count() == 4


def test_digests_expire(spark, tmp_path):
    store = seen.SeenSet(spark, f"file://{tmp_path}", ttl_days=30)
    keep(store, rows_of(spark, [(1, "a", "")]), "r1")
    keep(store, rows_of(spark, [(2, "b", "")]), "r2", NOW + timedelta(days=20))
    later = NOW + timedelta(days=31)
    assert keep(store, rows_of(spark, [(3, "a", ""), (4, "b", "")]), "r3", later) == [3]
    assert store.expire(later) == ["r1"] and store.known().count() == 2
    assert keep(store, rows_of(spark, [(5, "a", "")]), "r4", later) == []


@pytest.mark.parametrize("looked_up", [100_000, 0])
def test_random_runs_equal_brute_force(spark, tmp_path, monkeypatch, looked_up):
    monkeypatch.setattr(seen, "KEYS", 50)
    monkeypatch.setattr(seen, "LOOKED_UP", looked_up)
    rng, store, known, at = random.Random(1), seen.SeenSet(spark, f"file://{tmp_path}"), set(), 0
    for run in range(4):
        rows = [(at + i, str(rng.randint(0, 900)), "") for i in range(400)]
        at += 400
        want = []
        for i, c, _ in rows:
            if c not in known:
                known.add(c)
                want.append(i)
        assert keep(store, rows_of(spark, rows), f"r{run}") == want


def test_the_filter_never_denies_what_it_holds(spark):
    held = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"))
    blocks = -(-20_000 // seen.KEYS)
    bloom = seen.filter_of(held, blocks)
    assert bloom.count() == blocks
    assert seen.may_contain(held, bloom, blocks).where("not maybe").count() == 0
    others = spark.range(20_000, 60_000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"))
    assert seen.may_contain(others, bloom, blocks).where("maybe").count() < 400  # one in a hundred


def test_a_stream_keeps_the_first_of_each(spark, tmp_path):
    seen.use_rocksdb(spark)
    source, out = tmp_path / "in", tmp_path / "out"

    def batch(rows):
        spark.createDataFrame(rows, "digest string, idx long, late timestamp").coalesce(1).write.mode("append").parquet(str(source))

    def run(**options):
        stream = spark.readStream.schema("digest string, idx long, late timestamp").parquet(str(source))
        q = seen.first_seen(stream, ["idx"], **options).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted((r.digest or "-", r.idx) for r in spark.read.parquet(str(out)).collect())

    start = spark.createDataFrame([("old", NOW), ("old", NOW - timedelta(days=1))], "digest string, at timestamp")
    batch([("a", 3, NOW), ("a", 2, None), ("b", 1, NOW), ("old", 0, NOW), (None, 4, NOW), (None, 5, NOW)])
    assert run(seen=start) == [("-", 4), ("a", 2), ("b", 1)]
    # what comes late by its own time is a repeat or new by arrival alone
    batch([("a", 0, datetime(1999, 1, 1)), ("c", 9, datetime(1999, 1, 1)), ("c", 8, NOW)])
    assert run(seen=start) == [("-", 4), ("a", 2), ("b", 1), ("c", 8)]


def test_a_stream_forgets_after_a_time(spark, tmp_path):
    import time

    seen.use_rocksdb(spark)
    source = tmp_path / "in"
    found = []
    for i in range(2):
        spark.createDataFrame([("a", i)], "digest string, idx long").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("digest string, idx long").parquet(str(source))
        q = seen.first_seen(stream, ["idx"], ttl_ms=1000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        time.sleep(1.5)
        found = sorted(r.idx for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [0, 1]
