"""What grows with the input is done once for each row, text or header."""

import time

from pyspark.sql import functions as F

from mailstruct.functions import carrier, text
from mailstruct.sources import mime


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_a_wrapper_of_many_lines_does_not_cost_its_square(spark):
    n, began = 20_000, time.time()
    body = "\n".join(["own words"] * n + ["-----Original Message-----", "From: a@b"])
    row = spark.createDataFrame([(body,)], "body string").select(text.split_wrapper(F.col("body"), F.lit(True)).alias("w")).first().w
    assert row.wrapper_content == "\n".join(["own words"] * n) and row.quoted_content_preview == "-----Original Message-----\nFrom: a@b"
    assert time.time() - began < 30


def test_each_carrier_pattern_is_looked_for_once(spark):
    rows = spark.createDataFrame([("FW: x", "X-MC-Unique:1")], "subject string, headers string").repartition(1)
    shown = rows.select(carrier.details(F.col("subject"), F.col("headers")).alias("c")).select("c.*")
    assert plan(shown).count("RLIKE") == 2 * len(carrier.VENDORS) + len(carrier.USER_MARKS)
    assert shown.first().vendor == "mimecast"


def test_headers_of_a_mail_are_read_about_once(monkeypatch):
    inner = "".join(f"\n--b\nContent-Type: message/rfc822\n\nSubject: s{i}\nMessage-ID: <{i}@x>\nFrom: a@b\nContent-Type: text/plain; charset=utf-8\n\nbody {i}" for i in range(8))
    mail = ('Subject: o\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\nhi' + inner + "\n--b--\n").encode()
    calls, before = [], mime.ReadPolicy.header_fetch_parse
    monkeypatch.setattr(mime.ReadPolicy, "header_fetch_parse", lambda self, name, value: calls.append(name) or before(self, name, value))
    rows = mime.email_rows(1, mail)
    assert len({r["layer_seq"] for r in rows}) == 9
    assert len(calls) < 2.5 * mail.count(b": ")


def test_a_message_that_is_changed_is_read_again():
    m = mime.read_message(b"Subject: a\nContent-Type: text/html; charset=utf-8\n\nx")
    assert (m["subject"], m["none"], m.get("none", 1), m.get_content_type(), m.get_param("charset")) == ("a", None, 1, "text/html", "utf-8")
    del m["subject"], m["content-type"]
    m["subject"] = "b"
    assert (m["subject"], m.get_content_type(), m.get_param("charset")) == ("b", "text/plain", None)
