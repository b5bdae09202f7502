"""Headers by column expressions, against the parser."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from mailstruct.functions import headers
from mailstruct.plans.engine import SCALAR_HEADERS, all_values, extension_headers, header
from mailstruct.sources.mime import email_parts


def columns(rows, h):
    named = [header(h, n).alias(n.replace("-", "_")) for n in SCALAR_HEADERS]
    return rows.select("email_id", *named, all_values(h, "received").alias("received"), F.array_sort(F.map_entries(extension_headers(h))).alias("x"))


def both(spark, mails):
    """Of each mail: whether the columns are certain, what they read, and what the parser reads."""
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(mails)], "email_id long, content binary")
    read = rows.select("email_id", headers.outer_headers(F.col("content")).alias("o")).select("email_id", "o.*")
    sure = {r.email_id: r.certain for r in read.collect()}
    mine = {r.email_id: r for r in columns(read, F.col("headers")).collect()}
    parsed = email_parts(rows).where("part_seq = 0")
    theirs = {r.email_id: r for r in columns(parsed, F.col("headers")).collect()}
    return [(sure[i], mine[i], theirs[i]) for i in range(len(mails))]


def agree(spark, mails):
    """All that is certain is right; gives how many are."""
    found = both(spark, mails)
    for content, (sure, mine, theirs) in zip(mails, found, strict=True):
        assert not sure or mine == theirs, (content, mine, theirs)
    return sum(sure for sure, _, _ in found)


HAND = [
    b"", b"\n", b"\r\nSubject: body\n", b"Subject: a\n b\r\n\tc\rX-A: 1\n\nX-B: no", b"Subject:a\r\n\r\nX: 1", b"Subject: a\r\rX-B: no", b"From x@y Mon\nSubject: s\n\n", b" lost\nSubject: s\n",
    b"X-A: 1\nFrom x@y\n lost\nX-B: 2\n", b": none\n lost\nX-C: 3\nno header\nX-D: 4\n", b"Subject : x\n\n", b"X-A: 1\nx-a: 2\nX-A: 3\nReceived: a\n b\nReceived:\nReceived: c\n\n",
    "Subject: é\nX-A: ü".encode(), b"Subject: \xe9\xc3\nX: caf\xc3\xa9 \xff", b"Subject: a\x00b\x00\n\n", b"Subject:\n folded\n\n", b"Subject: trailing  \n\n", b"X-1~!: odd\n",
    b"From: a@b.c\nTo: B C <b@c>, <d@e>,f@g\nCc: \"Q, N\" <q@n>\nBcc: \"Q N\" <q@n>\nReply-To:   Foo   Bar <x@y>\n\n", b"To: undisclosed-recipients:;\n", b"To: a@b, , c@d\nFrom: (c) a@b\n", b"From: a@b (comment)\n",
    b"From: =?utf-8?q?J=C3=B6rg?= <a@b>\nTo: =?utf-8?b?w7Y=?= =?iso-8859-1?q?=E9,_x?= <c@d>\n", b"From: J. Doe <a@b>\n", b"From: \"J. Doe\" <a@b>\n", b"From: a.b@c.d\nTo: <a@b\n", b"From: a@b>\n", b"From: A a@b\n",
    b"Date: Mon, 1 Jan 2024 00:00:00 +0000\n", b"Date: Tue, 01 Jan 2024 10:20:30 -0530\n", b"Date: 31 Feb 2024 00:00:00 +0000\n", b"Date: today\n", b"Date:\n", b"Date: Mon, 1 Jan 2024 00:00:00 GMT\n", b"Date: 1 Jan 0024 00:00:00 +0000\n", b"Date: 5 May 2024 23:59:59 -0000\n",
    b"Message-ID: <a@b>\n", b"Message-ID: a@b\n", b"Message-ID: <a b>\n", b"Message-ID:  <a@b> \n", b"Return-Path: <r@x>\nReturn-Path: second\n",
]
HAND += [f"Subject: {s}\nX-S: {s}\n\n".encode("utf-8", "surrogateescape") for s in (
    "=?utf-8?q?J=C3=B6rg_a?= plain =?iso-8859-1?B?6Q==?=\n =?utf-8?q?_x?= end", "=?UTF-8?Q?a?==?utf-8?q?b?=", "a=?utf-8?q?b?=c", "=?utf-8?q?=ZZ?=", "=?utf-8?q?=4", "=?x?q?a?=", "=?utf-8?b?bad!?=", "=?utf-8?b?YQ?=", "=?windows-1252?q?=80=93=E9?=",
    "=?windows-1252?q?=81?=", "=?cp1252?b?gJM=?=", "=?us-ascii?q?a=20b?=", "=?us-ascii?q?=E9?=", "=?utf-8*en?q?a+b%41?=", "=?utf-8?q?a b?=", "=?utf-8?q??=", "=? ?=", "=?utf-8?x?a?=", "=?utf-8?q?a?b?=", "=?utf-8?q?=C3?= =?utf-8?q?=B6?=", "?= =?", "=?utf-8?q?=0A=0D=00?=",
    "=?iso-8859-1?q?=A0=C0=DF=e0=FF=7F=ab?=", "=?utf-8?b?4oKs?= =?utf-8?b?4oKs?=", "x =?utf-8?q?a?=  y  =?utf-8?q?b?=", "tab\t=?utf-8?q?a?=\t=?utf-8?q?b?=", "=?utf-8?q?=3D=3Futf-8=3Fq=3Fa=3F=3D?=", "=?=?utf-8?q?a?=",
)]


def test_hand_written_headers(spark):
    sure = agree(spark, HAND)
    assert sure >= len(HAND) * 0.55, sure


def test_usual_headers_leave_nothing_to_the_parser(spark):
    usual = [
        b"Subject: a\r\n folded\r\nFrom: \"Q, N\" <q@n.org>\r\nTo: Bob B <b@c>,<d@e>\r\nDate: Mon, 1 Jan 2024 00:00:00 +0000\r\nMessage-ID: <a.b@c>\r\nReceived: x\r\nX-A: 1\r\n\r\n",
        b"Subject: =?utf-8?q?J=C3=B6rg_a?= plain =?iso-8859-1?B?6Q==?=\n =?utf-8?q?_x?= end\nFrom: =?utf-8?q?J=C3=B6rg?= <a@b>\nReturn-Path: <r@x>\n\n", "Subject: é\nContent-Type: text/plain; charset=x\n\n".encode(), b"",
    ]
    assert agree(spark, usual) == len(usual)


def test_mails_that_columns_can_t_read_are_parsed(spark):
    from mailstruct.plans.engine import Engine

    mails = HAND + [b"From: J. Doe <a@b>\n\n"] * 2
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(mails)], "email_id long, content binary").repartition(4)
    got = {r.email_id: (r.subject, r.from_addr, r.date, r.received, r.x_headers) for r in Engine(spark).outer(rows).collect()}
    parsed = Engine(spark).headers(email_parts(rows).where("part_seq = 0")).collect()
    assert got == {r.email_id: (r.subject, r.from_addr, r.date, r.received, r.x_headers) for r in parsed} and len(got) == len(mails)


NAMES = ["Subject", "From", "To", "cc", "BCC", "Date", "Message-ID", "Reply-To", "Return-Path", "Received", "X-A", "x-a", "X-b", "Keywords", "Sender"]
ENDS = ["\n", "\r\n", "\r", "\n ", "\r\n\t"]
BITS = ["a", "Bob", " ", "  ", "\t", ",", "<", ">", "@", "x@y.z", "<x@y>", '"', '"q n"', "(c)", ":", ";", ".", "=?", "?=", "=?utf-8?q?", "=C3=B6", "=?utf-8?b?w7Y=?=", "=?iso-8859-1?q?=E9_x?=", "é", "\x00", "\x0b", "\udce9", "Mon, 1 Jan 2024 00:00:00 +0000", "=", "?", "_", "\\", "[", "1"]


@pytest.mark.parametrize("seed", range(4))
def test_random_mails(spark, seed):
    rng = random.Random(seed)
    mails = []
    for _ in range(1500):
        lines = []
        for _ in range(rng.randint(0, 4)):
            value = "".join(rng.choice(BITS) for _ in range(rng.choice([1, 1, 2, 3, 6])))
            lines.append(rng.choice(NAMES) + rng.choice([":", ": ", " :"] if rng.random() < 0.1 else [": "]) + value + (rng.choice(ENDS) if rng.random() < 0.3 else "\n"))
        mails.append(("".join(lines) + rng.choice(["", "\n", "\r\nX-Z: body", "junk\nX-Z: 1"])).encode("utf-8", "surrogateescape"))
    assert agree(spark, mails) > 300


def test_random_encoded_words(spark):
    rng = random.Random(9)
    mails = []
    for _ in range(600):
        words = []
        for _ in range(rng.randint(1, 4)):
            charset = rng.choice(["utf-8", "iso-8859-1", "windows-1252"])
            text = "".join(rng.choice("aZ09 _=?+%.,éßü€" if charset != "iso-8859-1" else "aZ09 _=?+%.,éßü") for _ in range(rng.randint(0, 12)))
            data = text.encode(charset)
            coded = base64.b64encode(data).decode() if rng.random() < 0.5 else "".join("_" if b == 32 else chr(b) if chr(b).isalnum() and b < 128 else f"={b:02X}" for b in data)
            words.append(f"=?{charset}?{'b' if coded.endswith('=') and '_' not in coded and base64.b64encode(data).decode() == coded else 'q' if '=' in coded or '_' in coded else 'Q'}?{coded}?=" if base64.b64encode(data).decode() != coded else f"=?{charset}?B?{coded}?=")
            words.append(rng.choice([" ", "\n ", " plain ", "  "]))
        mails.append(f"Subject: {''.join(words)}\n\nbody".encode())
    assert agree(spark, mails) > 500


def test_no_python_and_no_body(spark):
    rows = spark.createDataFrame([(1, b"Subject: s\n\n" + b"x" * 100)], "email_id long, content binary")
    plan = rows.select(headers.outer_headers(F.col("content")).alias("o"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    none = spark.createDataFrame([(1, None)], "email_id long, content binary").select(headers.outer_headers(F.col("content")).alias("o")).first().o
    assert none.headers == [] and none.certain
