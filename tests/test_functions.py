"""Goldens and properties of the scalar functions, settings and document readers."""

import io
import zipfile

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailstruct import config
from mailstruct.functions import carrier, errors, html, text, urls
from mailstruct.sources import documents


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_headers(spark):
    assert column(spark, [None, "", " a\r\n b\x00 \x00", "\xa0x\xa0"], text.clean_header) == ["", "", "a  b", "x"]


def test_urls(spark):
    found = column(spark, ["x HTTP://a.b/c). www.d.e, (https://f.g]", None, ""], urls.extract)
    assert found == [["HTTP://a.b/c", "www.d.e", "https://f.g"], [], []]
    cases = ["http://u@bit.ly:80/", "http://a.bit.ly/x", "https://BIT.LY/x", "bit.ly/x", "http://xbit.ly/"]
    assert column(spark, cases, urls.is_shortened) == [False, True, True, False, False]
    assert column(spark, ["http://e.com/abc", "http://e.com/abcdefghijk", "http://e.com/"], urls.is_probably_shortened) == [True, False, False]
    assert column(spark, ["HTTP://a.b/x?#'", "http://a.b/x?", "x.y)"], urls.clean) == ["http://a.b/x", "http://a.b/x", "x.y"]
    assert column(spark, ["https://s/?url=&target=http%3A%2F%2Fa%2Fb+c", "https://s/"], urls.unwrap_safelink) == ["http://a/b c", "https://s/"]
    assert column(spark, ["https://p/v1?u=http%253A%252F%252Fa%252Bb"], urls.unwrap_defense) == ["http://a+b"]
    assert column(spark, ["http://a/b.JPG?x", "http://a/b.jpg;p", "http://a/jpg"], urls.is_image) == [True, True, False]


def test_context(spark):
    long = "a" * 60 + " http://u " + "b" * 60
    assert column(spark, [long, "http://u", "none"], lambda c: urls.context(c, F.lit("http://u"))) == ["..." + "a" * 49 + " http://u " + "b" * 49 + "...", "http://u", ""]


def test_carriers(spark):
    assert column(spark, ["Trend  Micro", "ESA", "xESAx", "Re: QUARANTINE"], lambda c: carrier.vendor(c, F.lit(""))) == ["trend_micro", "ironport", None, "o365quar"]
    assert column(spark, ["a:b\nx-mc-y:1", "a: x-mc-y"], lambda c: carrier.vendor(F.lit(""), c)) == ["mimecast", None]
    assert column(spark, ["From: a@b\nSent: x\nTo: c@d", "From: a@b"], carrier.forwards) == [True, False]
    assert column(spark, ["a@b.com", "a@b.local", "x"], lambda c: carrier.internal(c, F.lit(""))) == [True, False, False]


def test_errors(spark):
    assert column(spark, ["FileNotFoundError", "Nope", "SecurityViolationError"], errors.status_of) == [404, 500, 413]
    assert column(spark, [3, 12], lambda c: errors.depth_error(c, 10)["message"], "int") == [None, "Nesting depth 12 exceeds limit 10"]


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.text())
def test_whitespace_is_idempotent(t):
    once = html.tidy(t)
    assert html.tidy(once) == once


@settings(max_examples=150, deadline=None, derandomize=True)
@example("<?")
@example("<!")
@example("<a b='")
@given(st.text())
def test_markup_never_raises(t):
    plain, links, _ = html.read(f"<div>{t}<a href='http://x'>{t}")
    assert plain == plain.strip()
    if "<" not in t:
        assert "http://x" in links


def test_what_a_browser_takes_for_a_comment_hides_the_tag_inside():
    assert html.read("<div><?<a href='http://x'>b<a href='http://y'>c") == ("b c http://y", ["http://y"], True) or html.read("<div><?<a href='http://x'>b<a href='http://y'>c")[1] == ["http://y"]
    assert html.read("<!-<a href='http://x'>b")[1] == html.read("</ <a href='http://x'>b")[1] == []


def test_markup():
    assert html.read('<p>a<b hidden>no</b></p><p style="opacity:0.9">gone</p><br>b&amp;c​')[0] == "a\n\nb&c"
    assert html.read('<img src="https://i/x"><a href="/r">r</a><link href="http://l">')[1] == ["http://l", "https://i/x"]
    assert html.read("é no < markup")[2] is False
    assert html.read("é")[0] == "e"


def test_settings():
    got = config.options_from({"PARSER_MAX_NESTED_DEPTH": "3", "PARSER_OCR_ENABLED": "no", "PARSER_OCR_TIMEOUT": "x", "PARSER_LOG_LEVEL": "debug"})
    assert (got.security.max_nested_depth, got.ocr.enabled, got.ocr.timeout_seconds, got.logging.level) == (3, False, 30, "DEBUG")
    with pytest.raises(ValueError, match="max_attachments must be positive"):
        config.options_from({"PARSER_MAX_ATTACHMENTS": "0"})
    assert config.options_from({"PARSER_MAX_ATTACHMENTS": "0"}, fallback=True) == config.EngineOptions()
    assert len(config.VARIABLES) == 29


def sheet(rows):
    cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r) + "</row>" for r in rows)
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'


def test_documents():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", sheet([["a", "bb"], ["1", "2"]]))
    assert documents.text_of_excel(out.getvalue()) == "=== Sheet: One ===\na bb\n1  2"
    assert documents.text_of_excel(b"x").startswith("[Error") and documents.text_of_pdf(b"x").startswith("[")
    assert documents.EXTRACTORS["text/html"](b"<b>x</b>").strip() == "x"


def test_stream(spark, tmp_path):
    from mailstruct.sources.eml import EmlDataSource
    from mailstruct.sources.requests import from_files, from_stream
    from mailstruct.streaming.mails import distinct_stream, stream_parts

    for i in range(3):
        (tmp_path / f"{i}.eml").write_bytes(f"Subject: s{i % 2}\n\nb".encode())
    rows = stream_parts(distinct_stream(from_stream(spark, str(tmp_path))))
    q = rows.writeStream.format("memory").queryName("parts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("parts").count() == 2
    assert from_files(spark, str(tmp_path)).where("error is null").count() == 3
    spark.dataSource.register(EmlDataSource)
    assert spark.read.format("eml").load(str(tmp_path)).where("part_seq = 0").count() == 3


def test_words_of_ascii_letters_alone_as_in_sql(spark):
    subjects = ["una óesa", "óesa", "xesa", "eſa", "ESA\x0b", "mımecast", "trend\xa0micro", "trend\x0bmicro", "trend\tmicro"]
    for words, want in (("unicode", [None, None, None, "ironport", "ironport", "mimecast", "trend_micro", "trend_micro", "trend_micro"]), ("ascii", ["ironport", "ironport", None, "ironport", "ironport", None, None, None, "trend_micro"])):
        assert column(spark, subjects, lambda c, w=words: carrier.vendor(c, F.lit(""), words=w)) == want
