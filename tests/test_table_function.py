"""The parse as a table function in SQL."""

import pytest
from test_mime import attached, embedded, mail, multi, nest

from mailstruct.sources import table_function
from mailstruct.sources.mime import email_parts

MAILS = [mail(), multi([embedded(mail("in", message_id="<i@x>")), attached(mail("file", message_id="<f@x>"), "f.eml")]), nest(3), "", "no mail at all", nest(12)]


@pytest.fixture
def mails(spark):
    table_function.register(spark)
    rows = spark.createDataFrame([(i, m.encode()) for i, m in enumerate(MAILS)] + [(99, None)], "email_id long, content binary")
    rows.createOrReplaceTempView("mails")
    return rows


def test_rows_are_those_of_the_parse(spark, mails):
    want = email_parts(mails.where("content is not null")).drop("email_id")
    got = spark.sql("SELECT p.* FROM mails m, LATERAL email_parts(m.content) p")
    assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_arguments(spark, mails):
    ask = lambda more: spark.sql(f"SELECT m.email_id, p.* FROM mails m, LATERAL email_parts(m.content{more}) p")
    assert "payload" not in ask(", payload => false").columns and "payload" in ask("").columns
    assert ask(", max_depth => 2").where("error is not null").count() == 2
    assert ask(", max_depth => 20").where("error is not null").count() == 0
    assert ask(", max_file_size_mb => 0").where("error like 'SecurityViolationError%'").count() == 5
    for more, message in ((", depth => 1", "no argument depth"), (", max_depth => 'x'", "constant number"), (", max_depth => m.email_id", "constant number"), (", max_depth => -1", "negative"), (", recursive => 1", "true or false")):
        with pytest.raises(Exception, match=message):
            ask(more).collect()
    with pytest.raises(Exception, match="bytes or text"):
        spark.sql("SELECT * FROM email_parts(1)").collect()
    assert spark.sql("SELECT * FROM email_parts('Subject: s\n\nb')").where("part_seq = 0").first().headers[0].v == "s"
