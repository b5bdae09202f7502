"""Hand-written mails through the parser and the whole engine."""

import base64
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mailstruct.config import EngineOptions, Modes, Security
from mailstruct.plans import render
from mailstruct.plans.engine import Engine, detector_bodies, invariants
from mailstruct.sources import mime
from mailstruct.sources.mime import email_rows, read_message, repaired
from mailstruct.sources.requests import with_outlook


def mail(subject="s", body="b", kind="text/plain", message_id="<m@x>", more=""):
    return f'Subject: {subject}\nFrom: a@example.com\nMessage-ID: {message_id}\n{more}MIME-Version: 1.0\nContent-Type: {kind}; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n{body}'


def multi(parts, subject="outer", message_id="<outer@x>", kind="mixed"):
    body = "".join(f"--b\n{p}\n" for p in parts)
    return f'Subject: {subject}\nMessage-ID: {message_id}\nMIME-Version: 1.0\nContent-Type: multipart/{kind}; boundary="b"\n\n{body}--b--\n'


def embedded(inner):
    return f"Content-Type: message/rfc822\n\n{inner}"


def attached(data, name, kind="application/octet-stream"):
    return f'Content-Type: {kind}; name="{name}"\nContent-Disposition: attachment; filename="{name}"\nContent-Transfer-Encoding: base64\n\n{base64.b64encode(data.encode()).decode()}'


def plain(text, kind="text/plain"):
    return f'Content-Type: {kind}; charset="utf-8"\nContent-Transfer-Encoding: 8bit\n\n{text}'


def roots(content, **options):
    return [r for r in email_rows(1, content.encode(), **options) if r.get("part_seq") == 0]


def nest(depth, tag="n"):
    out = mail(message_id=f"<{tag}{depth}@x>")
    for i in reversed(range(depth)):
        inner = out.replace('boundary="b"', f'boundary="b{i}"').replace("--b\n", f"--b{i}\n").replace("--b--", f"--b{i}--")
        out = multi([embedded(inner)], message_id=f"<{tag}{i}@x>")
    return out


def test_embedded_messages_become_layers_at_their_depth():
    layers = roots(nest(3))
    assert [(r["layer_seq"], r["layer_depth"]) for r in layers] == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_the_same_message_twice_is_one_layer():
    assert len(roots(multi([embedded(mail()), embedded(mail())]))) == 2


def test_attached_files_expand_one_level_and_keep_their_lineage():
    inner = multi([attached(mail(message_id="<c@x>"), "c.eml")], message_id="<i@x>").replace('"b"', '"q"').replace("--b", "--q")
    layers = roots(multi([attached(inner, "A.EML")]))
    assert [(r["layer_depth"], r["parent_layer_seq"], r["via_attachment"]) for r in layers] == [(0, None, None), (1, 0, "A.EML")]
    assert [r["layer_depth"] for r in roots(multi([attached(inner, "A.EML")]), recursive=True)] == [0, 1, 2]


def test_a_known_file_is_dropped_with_its_subtree():
    inner = multi([embedded(mail(message_id="<new@x>"))], message_id="<outer@x>").replace('"b"', '"q"').replace("--b", "--q")
    assert len(roots(multi([attached(inner, "x.eml")]))) == 1


def test_depth_limit_fails_the_mail():
    rows = email_rows(1, nest(11).encode(), max_depth=10)
    assert len(rows) == 1 and rows[0]["error"].startswith("SecurityViolationError")


def test_attachment_index_skips_empty_parts():
    rows = email_rows(1, multi([plain("x"), attached("", "empty.txt"), attached("1", "one.txt"), attached("2", "../two.txt")]).encode())
    assert [(r["att_idx"], r["filename"]) for r in rows if r["is_attachment"]] == [(1, "one.txt"), (2, "../two.txt")]


def test_indented_and_doubly_encoded_payloads_are_repaired():
    assert repaired(b"   Subject: hi\r\n   From: a\r\n\r\nbody")["subject"] == "hi"
    long = mail(body="x" * 900).encode()
    assert repaired(base64.b64encode(long))["subject"] == "s"
    assert repaired(None) is None and repaired([]) is None


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.binary(max_size=400))
def test_nothing_raises_on_any_bytes(data):
    rows = email_rows(1, data)
    assert rows and all(r["email_id"] == 1 for r in rows)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\r\0"), max_size=30), min_size=1, max_size=4))
def test_parts_are_those_of_the_walk(texts):
    content = multi([plain(t) for t in texts]).encode("utf-8")
    assert len(email_rows(1, content)) == len(list(read_message(content).walk()))


@pytest.fixture(scope="module")
def parsed(spark):
    corpus = {
        1: mail("FW: hi", "wrapper\n-----Original Message-----\nFrom: a@b.c\nline", more="X-A: 1\nX-A: 2\nReceived: r1\nReceived: r2\n"),
        2: multi([plain("see http://a.example/x."), plain('<p>hi <a href="https://b.example/y">there</a><span style="display:none">no</span></p>', "text/html")], kind="alternative"),
        3: multi([plain("first"), embedded(mail("inner", "inner body", message_id="<in@x>")), attached(mail("file", "f", message_id="<f@x>"), "x.eml"), attached("MZ", "run.EXE")]),
        4: mail(body="QUJD" * 250),
        5: "",
        6: mail("Fwd", "text\n---------- Forwarded message ---------\nmore"),
        7: nest(11),
    }
    mails = spark.createDataFrame([(k, v.encode()) for k, v in corpus.items()], "email_id long, content binary")
    return Engine(spark).parse(mails)


def by_layer(df):
    return {(r.email_id, r.layer_seq): r for r in df.collect()}


def test_layers(parsed):
    layers = by_layer(parsed.layers)
    one = layers[1, 0]
    assert (one.vendor, one.is_carrier, one.wrapper_content, one.received, one.x_headers) == ("user_forward", True, "wrapper", ["r1", "r2"], {"X-A": "2"})
    assert layers[2, 0].final_text == "hi there https://b.example/y" and layers[2, 0].has_html and layers[2, 0].has_plain
    assert layers[3, 0].plain_text.strip() == "inner body"  # the outer walk descends, so the last part wins
    assert layers[4, 0].final_text == "" and not layers[4, 0].has_plain
    assert layers[6, 0].wrapper_content is None
    assert {r.email_id for r in parsed.errors.collect()} == {7}


def test_links_relations_and_files(parsed):
    urls = [(r.original_url, r.pos) for r in parsed.urls.where("email_id = 2").orderBy("pos").collect()]
    assert urls == [("https://b.example/y", 0)] or [u for u, _ in urls] == ["https://b.example/y"]
    files = {r.filename: r for r in parsed.attachments.where("email_id = 3 and layer_seq = 0").collect()}
    assert set(files) == {"x.eml", "run.EXE"} and files["run.EXE"].is_suspicious_extension and files["x.eml"].is_nested_email
    parents = by_layer(parsed.parents)
    assert parents[3, 1].via_attachment == "x.eml" and parents[3, 2].parent_seq == 0


@pytest.mark.parametrize("name", [*render.FORMATS, "unknown"])
def test_responses(parsed, name):
    rows = {r.email_id: r for r in render.responses(parsed, name).collect()}
    assert set(rows) == set(range(1, 8)) and rows[7].status == 413
    data = json.loads(rows[3].response)["data"]
    if name == "summary":
        assert data["structural_summary"]["total_layers"] == 3 and data["consolidated_content_counts"]["total_attachments"] == 2
    elif name == "llm_optimized":
        assert len(data["threat_content"]["primary_threat_layers"]) == 3
    else:
        assert data["layers"][0]["message_id"] == "<outer@x>"


def test_scope_layer_and_exact_relations(spark):
    content = multi([plain("first"), embedded(mail("inner", "inner body", message_id="<in@x>")), attached(mail("file", message_id="<f@x>"), "x.eml")])
    mails = spark.createDataFrame([(1, content.encode())], "email_id long, content binary")
    got = Engine(spark, EngineOptions(modes=Modes(body_scope="layer", relations="exact"))).parse(mails)
    assert by_layer(got.layers)[1, 0].plain_text.strip() == "first"
    assert [r.layer_seq for r in got.parents.collect()] == [2]


def test_attachment_limit(spark):
    content = multi([attached(str(i), f"{i}.txt") for i in range(4)])
    mails = spark.createDataFrame([(1, content.encode())], "email_id long, content binary")
    got = Engine(spark, EngineOptions(security=Security(max_attachments=3))).parse(mails)
    assert got.errors.first().error.code == 413 and got.layers.count() == 0


def test_resolver_invariants_and_counters(spark):
    mails = spark.createDataFrame([(1, mail(body="http://bit.ly/a http://bit.ly/b http://x.example/c").encode())], "email_id long, content binary")
    engine = Engine(spark, EngineOptions(url_resolver=lambda u: "http://long" if u.endswith("a") else u))
    got = engine.parse(mails)
    assert [r.expanded_url for r in got.urls.orderBy("pos").collect()] == ["http://long", "Not Applicable", "Not Applicable"]
    assert {r.broken for r in invariants(got).collect()} == {0}
    layers, counters = engine.observed(got.layers)
    layers.collect()
    assert counters.get == {"layers": 1, "carriers": 0, "deepest": 0}


def test_detector_body(spark):
    corpus = {1: multi([plain("a"), plain("b")]), 2: multi([plain("<p>x</p>", "text/html")]), 3: mail(body="c" * 4000)}
    parts = Engine(spark).parts(spark.createDataFrame([(k, v.encode()) for k, v in corpus.items()], "email_id long, content binary"))
    got = {r.email_id: r.body for r in detector_bodies(parts).collect()}
    assert got[1].split() == ["a", "b"] and got[2].strip() == "x" and len(got[3]) == 3000


def test_outlook_files_without_the_library(spark):
    files = spark.createDataFrame([("a.msg", b"x", None), ("b.eml", b"y", None)], "path string, content binary, error struct<type: string, message: string, code: int, details: string>")
    got = {r.path: r for r in with_outlook(files).collect()}
    assert got["b.eml"].error is None and bytes(got["b.eml"].content) == b"y"
    assert got["a.msg"].error.type in ("DependencyError", "EmailParsingError")


def test_headers_read_as_by_the_default_policy():
    import email
    import email.policy

    raw = "\n".join(["Subject: a  b\tc", "Subject: =?utf-8?q?caf=C3=A9?= x", "From: A <a@b.c>,  d@e.f", "To: undisclosed", "Date: Mon, 1 Jan 2024 00:00:00 +0000", "X-A: folded", "  line", "X-B: caf\u00e9", "Received: from a", "\tby b", "Message-ID: <x@y> ", "Content-Type: text/plain; charset=utf-8", "Bad name: x", "", "body"]).encode()
    default = email.message_from_bytes(raw, policy=email.policy.default)
    got = mime.all_headers(read_message(raw))
    assert [(r["k"], r["v"]) for r in got] == [(k, mime.scalar(str(v))) for k, v in default.items()]


def test_links_and_chains_know_where_they_were_found(spark):
    inner = multi([plain("inner http://a.example/1"), attached("sheet", "s.bin"), attached("img", "i.png", "image/png")], message_id="<in@x>")
    content = multi([plain("see http://a.example/1"), attached(inner, "x.eml")])
    mails = spark.createDataFrame([(1, content.encode())], "email_id long, content binary")
    options = EngineOptions(ocr_reader=lambda data: f"read http://ocr.example/{len(data)}.", image_extractors={"application/octet-stream": lambda data: [("in.png", b"xyz")]}, text_extractors={"application/octet-stream": lambda data: "in file http://file.example/"})
    got = Engine(spark, options).parse(mails)
    (row,) = render.responses(got, "llm_optimized").collect()
    threat = json.loads(row.response)["data"]["threat_content"]
    assert {"http://a.example/1"} <= {u["url"] for u in threat["all_urls_with_provenance"]}
    (pattern,) = [p for p in threat["suspicious_content_patterns"] if "s.bin" in p["chain_description"]]
    assert pattern["pattern_type"] == "url_in_image_in_attachment_in_nested_email" and "embedded_image(in.png)" in pattern["chain_description"]
    (full,) = render.responses(got, "standard").collect()
    whole = json.loads(full.response)["data"]["consolidated_content"]
    assert any(i["source"] == "embedded_image" and i["parent_chain"][-1] == "embedded_image" for i in whole["all_images"])
    got.release()
