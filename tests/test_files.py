"""Mail files as tables and streams, and payloads as files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from mailstruct.sources import eml, requests
from mailstruct.sources.sink import PayloadSink, PayloadWriter, manifest


@pytest.fixture
def folder(spark, tmp_path):
    eml.register(spark)
    spark.dataSource.register(PayloadSink)
    for i in range(20):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"m{i:02}.eml").write_bytes(f"Subject: s{i}\n\n{'b' * i * 100}".encode())
    (tmp_path / "d0" / "note.txt").write_text("x")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "h.eml").write_text("x")
    return tmp_path


def mail(spark, folder, **options):
    return spark.read.format("mail").options(**options).load(str(folder))


def test_files_have_the_ids_paths_and_bytes_that_spark_gives_them(spark, folder):
    got = {r.path: (r.email_id, r.size, bytes(r.content)) for r in mail(spark, folder).collect()}
    want = {r.path: (r.email_id, r.size, bytes(r.content)) for r in requests.from_files(spark, str(folder)).collect()}
    assert got == want and len(got) == 20
    assert mail(spark, "file:" + str(folder)).count() == mail(spark, folder / "d0" / "m00.eml").count() + 19 == 20


def test_options_decide_before_files_are_opened(spark, folder):
    names = lambda **o: sorted(r.path[-7:-4] for r in eml.scan(spark, str(folder), content="false", **o).collect())
    assert names(min_size=510, path_like="*/d1/*") == ["m07", "m10", "m13", "m16", "m19"]
    assert names(max_size=113) == ["m00", "m01"] and names(min_size=113, max_size=113) == ["m01"]
    for i, f in enumerate(sorted(folder.rglob("*.eml"))):
        os.utime(f, (1000 * i, 1000 * i))
    assert len(names(modified_after="1970-01-01T00:50:00+00:00")) == 18
    assert len(names(modified_before="1970-01-01T00:50:00+00:00", modified_after="1970-01-01T00:16:40+00:00")) == 2
    assert eml.scan(spark, str(folder), content="false").columns == ["email_id", "path", "modified", "size"]


def test_queries_of_one_frame_do_not_share_conditions(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = mail(spark, folder)
    some, few = rows.where("size > 500"), rows.where("size > 1500")
    assert (some.count(), rows.count(), few.count(), some.union(few).count()) == (15, 20, 5, 20)


def test_pushed_conditions_equal_spark_s_own(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = eml.PushedReader({"path": str(folder)})
    left = list(reader.pushFilters([eml.GreaterThan(("size",), 500), eml.StringContains(("path",), "/d1/"), eml.EqualTo(("content",), b"")]))
    assert [f.attribute for f in left] == [("content",)] and sum(len(p.files) for p in reader.partitions()) == 5
    rows = spark.createDataFrame(mail(spark, folder).collect(), "email_id long, path string, modified timestamp, size long, content binary")
    conditions = ("size > 500 and size <= 1500 and path like '%/d1/%'", "path not like '%m1_.eml' and size >= 100", f"email_id = {eml.listed(str(folder))[3].email_id}", "modified > '2020-01-01' and size < 300")
    for condition in (*conditions, "size in (9, 113) or path like '%9.eml'", "modified < timestamp'2020-01-01'", "not (path like 'file%') or size in (113, 214)", "size <> 113 and path <> 'x' and path like '%.eml'"):
        got = mail(spark, folder, pushdown="true").where(condition)
        assert {r.path for r in got.collect()} == {r.path for r in rows.where(condition).collect()}


def test_small_files_share_partitions(spark, folder):
    files = [eml.MailFile(str(i), size, 0) for i, size in enumerate([10, 20, 500_000, 30, 40])]
    packs = eml.packed(files, 3 * eml.OPEN_BYTES)
    assert [[f.path for f in p.files] for p in packs] == [["0", "1"], ["2"], ["3", "4"]]
    assert mail(spark, folder).rdd.getNumPartitions() == 1
    assert mail(spark, folder, partitionBytes=4 * eml.OPEN_BYTES).rdd.getNumPartitions() >= 5
    assert eml.packed([]) == []


def test_empty_and_missing_folders(spark, folder, tmp_path):
    (tmp_path / "none").mkdir()
    assert mail(spark, tmp_path / "none").count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        mail(spark, tmp_path / "nowhere").count()
    with pytest.raises(Exception, match="path is needed"):
        spark.read.format("mail").load().count()


def test_parts_are_the_same_from_files_and_tables(spark, folder):
    from mailstruct.sources.mime import email_parts

    parts = spark.read.format("eml").load(str(folder)).where("part_seq = 0").select("email_id", "headers", "text")
    again = email_parts(mail(spark, folder)).where("part_seq = 0").select("email_id", "headers", "text")
    assert sorted(parts.collect()) == sorted(again.collect()) and parts.count() == 20


def run(spark, rows, checkpoint, name):
    q = rows.writeStream.format("parquet").option("path", str(checkpoint / name)).option("checkpointLocation", str(checkpoint / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(str(checkpoint / name))


def test_a_stream_takes_up_where_it_stopped(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    stream = lambda **o: spark.readStream.format("mail").options(**o).load(str(folder))
    assert run(spark, stream(), out, "rows").count() == 20
    for i in range(20, 23):
        (folder / "d0" / f"n{i}.eml").write_bytes(b"Subject: x\n\n")
    got = run(spark, stream(), out, "rows")
    assert got.count() == 23 == got.select("path").distinct().count()
    assert {r.email_id for r in got.collect()} == {r.email_id for r in mail(spark, folder).collect()}


def test_offsets_cut_the_files_by_time_and_path(folder):
    for i, f in enumerate(sorted(folder.rglob("*.eml"))):
        os.utime(f, ns=(10**9 * (i // 4), 10**9 * (i // 4)))
    stream = eml.MailStream({"path": str(folder), "maxFilesPerTrigger": "3"})
    at, seen = stream.initialOffset(), []
    for _ in range(9):
        end = stream.latestOffset()
        batch = [f.path for p in stream.partitions(at, end) for f in p.files]
        # another reader, as after a restart, gives the same batch
        assert batch == [f.path for p in eml.MailStream({"path": str(folder)}).partitions(at, end) for f in p.files]
        seen, at = seen + batch, end
    assert len(seen) == len(set(seen)) == 20
    young = eml.MailStream({"path": str(folder), "settleSeconds": "3600"})
    (folder / "d0" / "late.eml").write_text("x")
    assert not young.latestOffset()["path"].endswith("late.eml")


def test_payloads_are_written_once_by_their_digest(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sink"))
    data = [b"a", b"a", b"b" * 5000, None, b""] * 7
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, payload binary").repartition(5)
    for _ in range(2):
        rows.write.format("payloads").option("suffix", ".bin").mode("append").save(out)
    names = {hashlib.sha256(d).hexdigest(): d for d in data if d is not None}
    assert {f"{d[:2]}/{d}.bin" for d in names} == {os.path.relpath(os.path.join(at, f), out) for at, _, files in os.walk(out) for f in files if f.endswith(".bin")}
    for d, content in names.items():
        with open(f"{out}/{d[:2]}/{d}.bin", "rb") as f:
            assert f.read() == content
    listed = manifest(spark, out).distinct().collect()
    assert {(r.sha256, r.size) for r in listed} == {(d, len(c)) for d, c in names.items()}
    assert not os.listdir(f"{out}/_staging")


def test_a_task_that_dies_leaves_nothing_half_done(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sink"))

    @F.udf("binary")
    def fails(i):
        if i == 900:
            raise RuntimeError("killed")
        return str(i).encode() * 100

    rows = spark.range(0, 1000, 1, 4).select(fails("id").alias("payload"))
    with pytest.raises(Exception, match="killed"):
        rows.write.format("payloads").mode("append").save(out)
    whole = [os.path.join(at, f) for at, _, files in os.walk(out) for f in files]
    assert not any("_manifests" in f for f in whole)
    # a task that was still running may have left its staging folder; nothing reads it
    for f in (f for f in whole if "_staging" not in f):
        with open(f, "rb") as g:
            assert hashlib.sha256(g.read()).hexdigest() == os.path.basename(f)
    rows.where("id <> 900").write.format("payloads").mode("append").save(out)
    assert manifest(spark, out).count() == 999


def test_a_killed_attempt_is_invisible(tmp_path):
    class Row(dict):
        pass

    def dies():
        yield Row(payload=b"one")
        raise KeyboardInterrupt

    writer = PayloadWriter({"path": str(tmp_path)}, ["payload"], False)
    with pytest.raises(KeyboardInterrupt):
        writer.write(dies())
    message = writer.write(iter([Row(payload=b"one"), Row(payload=b"two"), Row(payload=b"two")]))
    writer.commit([message, None])
    files = [f for _, _, names in os.walk(tmp_path) for f in names]
    assert sorted(f for f in files if len(f) == 64) == sorted(hashlib.sha256(x).hexdigest() for x in (b"one", b"two"))
    with pytest.raises(ValueError, match="only ever added"):
        PayloadWriter({"path": str(tmp_path)}, ["payload"], True)
    with pytest.raises(ValueError, match="no column"):
        PayloadWriter({"path": str(tmp_path)}, ["x"], False)
