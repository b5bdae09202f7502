"""The stream of first rows without a time to live."""

import random

import pyarrow as pa
import pytest

from mailstruct.operators import seen


@pytest.mark.parametrize("gathered", [3, 200_000])
def test_a_task_finds_the_first_of_each_digest(monkeypatch, gathered):
    monkeypatch.setattr(seen, "GATHERED", gathered)
    rng = random.Random(gathered)
    rows = [(rng.choice(["a", "b", "é", "", None]), rng.choice([None, *range(9)]), i) for i in range(60)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("digest", "idx", "n"), r, strict=True)) for r in rows[i : i + 7]], pa.schema([("digest", pa.string()), ("idx", pa.int64()), ("n", pa.int64())])) for i in range(0, 60, 7)]
    want = {}
    for d, idx, n in rows:
        place = (idx is not None, idx or 0, n)
        want[d] = min(want.get(d, place), place)
    found = pa.Table.from_batches(list(seen.first_of_task(["idx", "n"])(iter(batches)))).to_pylist()
    assert {r["digest"]: (r["idx"] is not None, r["idx"] or 0, r["n"]) for r in found} == want and len(found) == len(want)
    some = pa.Table.from_batches(list(seen.first_of_task(["idx", "n"], whole=False)(iter(batches))))
    assert pa.Table.from_batches(list(seen.first_of_task(["idx", "n"])(iter(some.to_batches())))).to_pylist() == found and some.num_rows < 60
    assert list(seen.first_of_task(["idx"])(iter([]))) == []


def test_a_stream_without_time_to_live_needs_no_call_for_each_digest(spark, tmp_path):
    seen.use_rocksdb(spark)
    rng, known, states = random.Random(5), {}, set()
    for batch in range(3):
        rows = [(rng.choice(["x", None, *map(str, range(40))]), batch * 100 + i) for i in rng.sample(range(100), 60)]
        for d, i in sorted(rows, key=lambda r: r[1]):
            known.setdefault(d, i)
        spark.createDataFrame(rows, "digest string, idx long").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        first = seen.first_seen(spark.readStream.schema("digest string, idx long").parquet(str(tmp_path / "in")), ["idx"])
        q = first.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        states |= {s.operatorName for p in q.recentProgress for s in p.stateOperators}
        assert {r.digest: r.idx for r in spark.read.parquet(str(tmp_path / "out")).collect()} == known
    assert states == {"dedupe"}
