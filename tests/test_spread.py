"""How many tasks a parse gets."""

from mailstruct.sources import mime


def test_never_fewer_tasks_than_the_input_had(spark):
    rows = spark.createDataFrame([(i, b"Subject: s\n\nb") for i in range(200)], "email_id long, content binary")
    assert mime.email_parts(rows.repartition(64)).rdd.getNumPartitions() == 64
    assert mime.spread(rows, "email_id").rdd.getNumPartitions() >= 4


def test_more_tasks_for_more_input(spark, tmp_path, monkeypatch):
    spark.range(50_000).selectExpr("id AS email_id", "cast(sha2(cast(id AS string), 512) AS binary) AS content").coalesce(1).write.parquet(str(tmp_path / "mails"))
    rows = spark.read.parquet(str(tmp_path / "mails"))
    size = mime.input_bytes(rows)
    assert size > 1 << 20
    monkeypatch.setattr(mime, "TASK_BYTES", size // 20)
    assert mime.spread(rows, "email_id").rdd.getNumPartitions() in (20, 21)
    monkeypatch.setattr(mime, "TASK_BYTES", 1 << 40)
    assert mime.spread(rows, "email_id").rdd.getNumPartitions() == 4
