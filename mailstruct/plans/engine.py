"""The plan from raw mail to result tables. One parse in Python, one markup pass, everything else relational by e-mail.

Columns of layers need one shuffle by layer; a whole parse writes each table once, and what follows reads these.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mailstruct.config import EngineOptions
from mailstruct.functions import carrier, deadline, errors, headers, html, text, urls
from mailstruct.operators import relate, summary
from mailstruct.plans.scratch import Scratch
from mailstruct.sources.mime import email_parts, spread

KEY = ["email_id", "layer_seq"]
SCALAR_HEADERS = ("subject", "from", "to", "cc", "bcc", "date", "message-id", "reply-to", "return-path")


def header(headers: Column, name: str) -> Column:
    """The first value of a header, cleaned; empty without one."""
    found = F.filter(headers, lambda h: F.lower(h["k"]) == name)
    return text.clean_header(F.get(found, F.lit(0))["v"])


def named(headers: Column) -> Column:
    """struct of SCALAR_HEADERS, as header() gives them: the first value of each, cleaned; empty without one. Names are put in lower case once."""

    def first(x: Column) -> Column:
        value = lambda n: F.get(headers, (F.array_position(x, n) - 1).cast("int"))["v"]
        return F.struct(*(text.clean_header(value(n)).alias(n.replace("-", "_").replace("from", "from_addr")) for n in SCALAR_HEADERS))

    return text.let(F.transform(headers, lambda h: F.lower(h["k"])), first)


def all_values(headers: Column, name: str) -> Column:
    return F.transform(F.filter(headers, lambda h: F.lower(h["k"]) == name), lambda h: text.clean_header(h["v"]))


def extension_headers(headers: Column) -> Column:
    """Names that begin with x-, as written, to their last value."""
    own = F.filter(headers, lambda h: F.lower(h["k"]).startswith("x-"))
    names = F.array_distinct(F.transform(own, lambda h: h["k"]))
    last = lambda n: F.element_at(F.filter(own, lambda h: h["k"] == n), -1)["v"]
    return F.map_from_arrays(names, F.transform(names, lambda n: text.clean_header(last(n))))


def blob(headers: Column) -> Column:
    """All headers as name:value lines."""
    return F.array_join(F.transform(headers, lambda h: F.concat(h["k"], F.lit(":"), h["v"])), "\n")


def read_off(reader, image: bytes | None, largest: int) -> tuple[str | None, str | None]:
    """(text, error): what the supplied reader finds on an image of at most so many bytes; its failure leaves the image without text."""
    if reader is None or not image or len(image) > largest:
        return None, None
    try:
        return (reader(bytes(image)) or "").strip() or None, None
    except Exception as e:  # noqa: BLE001
        return None, deadline.problem(e)


def with_ocr(images: DataFrame, options: EngineOptions) -> DataFrame:
    """ocr_text by the supplied reader, capped, and ocr_error; both null without one. A reader that takes longer than ocr.timeout_seconds
    for an image is stopped, and the next image gets a new one."""
    reader, largest = options.ocr_reader if options.ocr.enabled else None, options.ocr.max_image_size_mb << 20
    if reader is None:
        return images.withColumns({"ocr_text": F.lit(None).cast("string"), "ocr_error": F.lit(None).cast("string")})
    limited = deadline.Limited(reader, options.ocr.timeout_seconds)

    @F.pandas_udf("text string, error string")
    def read(payloads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_off(limited, data, largest) for data in payloads], columns=["text", "error"])

    out = images.withColumn("_ocr", read("payload"))
    return out.withColumns({"ocr_text": text.cap(F.col("_ocr.text"), options.processing.max_ocr_text_length), "ocr_error": F.col("_ocr.error")}).drop("_ocr")


def with_text(attachments: DataFrame, options: EngineOptions) -> DataFrame:
    """text_content of attachments whose type has an extractor."""
    extractors = dict(options.text_extractors)
    if not extractors:
        return attachments.withColumn("text_content", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def extract(kinds: pd.Series, payloads: pd.Series) -> pd.Series:
        def one(kind, data):
            try:
                return extractors[kind](bytes(data)) if kind in extractors else None
            except Exception as e:  # noqa: BLE001
                return f"[Text extraction failed: {e}]"

        return pd.Series([one(k, d) for k, d in zip(kinds, payloads, strict=True)], dtype=object)

    return attachments.withColumn("text_content", extract("content_type", "payload"))


def with_embedded(attachments: DataFrame, options: EngineOptions) -> DataFrame:
    """embedded_images of attachments whose type has an extractor of images: name, size, text read off each, and its links."""
    kind = "array<struct<filename: string, size: long, ocr_text: string>>"
    extractors, reader = dict(options.image_extractors), options.ocr_reader if options.ocr.enabled else None
    if not extractors:
        found = F.array().cast(kind)
    else:
        largest = options.ocr.max_image_size_mb << 20
        limited = None if reader is None else deadline.Limited(reader, options.ocr.timeout_seconds)

        @F.pandas_udf(kind)
        def extract(kinds: pd.Series, payloads: pd.Series) -> pd.Series:
            def one(kind, data):
                try:
                    return [{"filename": name, "size": len(image), "ocr_text": read_off(limited, image, largest)[0]} for name, image in extractors[kind](bytes(data))] if kind in extractors else []
                except Exception:  # noqa: BLE001  a file that can't be read holds no images
                    return []

            return pd.Series([one(k, d) for k, d in zip(kinds, payloads, strict=True)], dtype=object)

        found = extract("content_type", "payload")
    capped = lambda x: text.cap(x["ocr_text"], options.processing.max_ocr_text_length)
    return attachments.withColumn("embedded_images", F.transform(found, lambda x: F.struct(x["filename"].alias("filename"), x["size"].alias("size"), capped(x).alias("ocr_text"), urls.extract(capped(x)).alias("urls_from_ocr"))))


def detector_bodies(parts: DataFrame) -> DataFrame:
    """email_id, layer_seq, body: the text that scored detection reads. Plain parts in order, a line end after each; without
    any, the last markup part with its tags as blanks; a layer of one part is read as it is. Cut at 3,000 characters.
    """
    some = parts.where("text is not null and text <> ''").where(~F.col("multipart") | F.col("filename").isNull())
    plain, markup = F.col("content_type") == "text/plain", F.col("content_type") == "text/html"
    rows = some.groupBy(*KEY).agg(
        F.bool_or("multipart").alias("multipart"),
        summary.ordered(F.when(plain, F.col("text")), "part_seq").alias("plain"),
        F.max(F.when(markup, F.struct("part_seq", "text"))).alias("markup"),
    )
    joined = F.concat(F.array_join("plain", "\n"), F.when(F.col("multipart"), F.lit("\n")).otherwise(F.lit("")))
    bare = F.when(F.col("multipart"), F.regexp_replace("markup.text", "<[^>]+>", " ")).otherwise(F.col("markup.text"))
    body = F.when(F.size("plain") > 0, joined).otherwise(F.coalesce(bare, F.lit("")))
    return rows.select(*KEY, F.left(body, F.lit(carrier.BODY_HEAD)).alias("body"))


def resolved(links: DataFrame, options: EngineOptions) -> DataFrame:
    """expanded_url of shortened links by the supplied resolver, each different link once; without one nothing is looked up."""
    resolver = options.url_resolver if options.urls.enable_expansion else None
    if resolver is None:
        return links

    limited = deadline.Limited(resolver, options.urls.expansion_timeout)

    @F.pandas_udf("string")
    def look_up(found: pd.Series) -> pd.Series:
        def one(url):
            try:
                return limited(url)
            except Exception:  # noqa: BLE001  a link that can't be resolved stays
                return None

        return found.map(one)

    known = links.where("is_shortened").select(F.col("original_url").alias("short")).distinct().withColumn("long", look_up("short"))
    return urls.expand(links, known)


def invariants(parsed: Parsed) -> DataFrame:
    """rule, broken: how many rows break each rule; all are 0 for a sound result."""
    rules = {
        "layer without key": (parsed.layers, F.col("layer_seq").isNull() | F.col("email_id").isNull()),
        "negative depth": (parsed.layers, F.col("layer_depth") < 0),
        "carrier without vendor": (parsed.layers, F.col("is_carrier") & F.col("vendor").isNull()),
    }
    counts = [t.agg(F.lit(name).alias("rule"), F.count_if(broken).alias("broken")) for name, (t, broken) in rules.items()]
    own = parsed.layers.select(*KEY)
    for name, t in (("attachment", parsed.attachments), ("image", parsed.images), ("link", parsed.urls)):
        counts.append(t.join(own, KEY, "left_anti").agg(F.lit(f"{name} without layer").alias("rule"), F.count("*").alias("broken")))
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


@dataclass
class Parsed:
    """The tables of a parsed corpus, written but for the last three; payloads are in parts alone."""

    parts: DataFrame
    errors: DataFrame
    layers: DataFrame
    attachments: DataFrame
    images: DataFrame
    urls: DataFrame
    references: DataFrame
    parents: DataFrame
    scratch: Scratch

    def release(self) -> None:
        """Removes what the parse wrote; the tables can't be read after that."""
        self.scratch.clear()


class Engine:
    """Parses tables of mails (email_id, content) with fixed options."""

    def __init__(self, spark: SparkSession, options: EngineOptions | None = None):
        self.spark, self.options = spark, (options or EngineOptions()).validate()

    def parts(self, mails: DataFrame, with_payload: bool = True) -> DataFrame:
        s = self.options.security
        return email_parts(mails, s.max_nested_depth, self.options.modes.recursive_eml, with_payload, s.max_file_size_mb)

    def headers(self, roots: DataFrame) -> DataFrame:
        """Layers' own columns and those of their headers, from each layer's first part; a row each, without a shuffle."""
        h = F.col("headers")
        keep = [c for c in roots.columns if c in ("plain", "html")]
        read = roots.withColumn("_n", named(h))
        return read.select(*KEY, "layer_depth", "parent_layer_seq", "via_attachment", "via_mime_type", "signature", "_n.*", all_values(h, "received").alias("received"), extension_headers(h).alias("x_headers"), carrier.details(F.col("_n.subject"), blob(h), self.options.modes.vendor_headers).alias("carrier"), *keep)

    def outer(self, mails: DataFrame, parse_rest: bool = True) -> DataFrame:
        """email_id and the columns of the mails' own headers, read by column expressions alone; no part is looked at.

        Mails with a header whose reading isn't certain go to the parser; without parse_rest these headers stay as written.
        """
        read = mails.select(F.col("email_id").cast("long").alias("email_id"), "content", headers.outer_headers(F.col("content")).alias("o"))
        found = read.select("email_id", "o.*").where("certain" if parse_rest else "true").select("email_id", "headers")
        if parse_rest:
            rest = self.parts(read.where("not o.certain").select("email_id", "content"), with_payload=False)
            found = found.unionAll(rest.where("part_seq = 0 and layer_seq = 0").select("email_id", "headers"))
        h = F.col("headers")
        return found.withColumn("_n", named(h)).select("email_id", "_n.*", all_values(h, "received").alias("received"), extension_headers(h).alias("x_headers"))

    def layers(self, parts: DataFrame) -> DataFrame:
        """All columns of layers. A layer's body is its last plain and its last markup part; markup also gives text and links."""
        scope = F.lit(True) if self.options.modes.body_scope == "walk" else F.col("own")
        # a layer of one part has its body there, whatever its name
        counts = scope & F.col("text").isNotNull() & (F.col("text") != "") & (~F.col("multipart") | F.col("filename").isNull())
        markup, value = (F.col("content_type") == "text/html") | F.col("has_markup"), F.struct("part_seq", "text")
        root = ["layer_depth", "parent_layer_seq", "via_attachment", "via_mime_type", "signature", "headers"]
        # dealt evenly by layer: Spark would join small partitions, and reading markup is bound by processors
        needed = spread(parts.where((F.col("part_seq") == 0) | counts), *KEY)
        best = needed.groupBy(*KEY).agg(
            F.max(F.when(F.col("part_seq") == 0, F.struct(*root))).alias("root"),
            F.max(F.when(counts & ~markup, value)).alias("plain"),
            F.max(F.when(counts & markup, value)).alias("html"),
        )
        out = self.headers(best.select(*KEY, "root.*", F.coalesce("plain.text", F.lit("")).alias("plain"), F.coalesce("html.text", F.lit("")).alias("html")))
        read = html.parsed(F.col("html"), self.options.processing.aggressive_html_cleaning)
        out = out.select("*", text.blank_base64(F.col("plain")).alias("plain_text"), F.col("html").alias("html_text"), read.alias("m")).drop("plain", "html")
        final = text.final_text(F.col("m.text"), F.col("plain_text"))
        out = out.select("*", F.col("m.text").alias("converted_text"), F.col("m.links").alias("html_links"), final.alias("final_text")).drop("m")
        out = out.withColumn("is_carrier", F.col("carrier.is_carrier")).withColumn("vendor", F.col("carrier.vendor")).withColumn("carrier_summary", carrier.layer_summary(F.col("is_carrier")))
        split = text.split_wrapper(F.col("final_text"), F.col("is_carrier"))
        out = out.withColumn("_w", split).select("*", "_w.wrapper_content", "_w.quoted_content_preview", "_w.content_summary").drop("_w")
        return out.withColumn("has_html", F.col("html_text") != "").withColumn("has_plain", F.col("plain_text") != "")

    def attachments(self, parts: DataFrame) -> DataFrame:
        name = F.coalesce("filename", F.concat(F.lit("attachment_"), F.col("att_idx").cast("string")))
        rows = parts.where("is_attachment").select(*KEY, "layer_depth", F.col("att_idx").alias("idx"), name.alias("filename"), "content_type", "payload")
        extension = F.lower(F.regexp_extract("filename", r"[^./\\](\.[^./\\]+)\z", 1))
        rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("sha256"), extension.alias("extension"))
        rows = rows.withColumn("is_suspicious_extension", F.col("extension").isin(".exe", ".scr", ".bat", ".cmd"))
        rows = rows.withColumn("is_nested_email", F.lower("filename").endswith(".eml") | (F.col("content_type") == "message/rfc822"))
        found = with_embedded(with_text(rows, self.options), self.options)
        return found.withColumn("urls", F.when(F.col("text_content").isNotNull(), urls.extract(F.col("text_content"))).otherwise(F.array().cast("array<string>")))

    def images(self, parts: DataFrame) -> DataFrame:
        rows = parts.where("image_idx is not null")
        if self.options.modes.body_scope != "walk":
            rows = rows.where("own")
        name = F.coalesce("filename", F.concat(F.lit("image_"), F.col("image_idx").cast("string"), F.lit(".png")))
        rows = rows.select(*KEY, "layer_depth", F.col("image_idx").alias("idx"), name.alias("filename"), "content_id", "content_type", "payload", F.octet_length("payload").cast("long").alias("size"))
        return with_ocr(rows, self.options).withColumn("urls_from_ocr", urls.extract(F.col("ocr_text")))

    def layer_urls(self, layers: DataFrame, attachments: DataFrame, images: DataFrame) -> DataFrame:
        """Each layer's links once, in order: text, markup, attachments, images."""
        files = attachments.where(F.size("urls") > 0).select(*KEY, F.lit(0).alias("kind"), "idx", "urls")
        files = files.unionAll(images.where(F.size("urls_from_ocr") > 0).select(*KEY, F.lit(1).alias("kind"), "idx", F.col("urls_from_ocr").alias("urls")))
        files = files.groupBy(*KEY).agg(F.flatten(summary.ordered(F.col("urls"), "kind", "idx")).alias("urls"))
        out = layers.select(*KEY, "layer_depth", "final_text", "html_links").join(files, KEY, "left")
        none = F.array().cast("array<string>")
        found = F.concat(urls.extract(F.col("final_text")), *(F.coalesce(c, none) for c in ("html_links", "urls")))
        rows = out.select(*KEY, "layer_depth", "final_text", F.posexplode(urls.process(found)).alias("pos", "u")).select(*KEY, "layer_depth", "pos", "u.*", "final_text")
        return rows.withColumn("source", F.lit("body_text")).withColumn("context_snippet", urls.context(F.col("final_text"), F.col("original_url"))).drop("final_text")

    def observed(self, layers: DataFrame) -> tuple[DataFrame, Observation]:
        """layers, and counters that are known once an action has run over them."""
        counters = Observation("layers")
        return layers.observe(counters, F.count("*").alias("layers"), F.count_if("is_carrier").alias("carriers"), F.max("layer_depth").alias("deepest")), counters

    def parse(self, mails: DataFrame) -> Parsed:
        """All tables. Each is written once, since several results read it; release() removes them."""
        work = Scratch(self.spark)
        all_parts = work.write(self.parts(mails), "parts")
        bad = all_parts.where("error is not null").select("email_id", F.element_at(F.split("error", ": "), 1).alias("type"), "error")
        parts, limit = all_parts.where("error is null"), self.options.security.max_attachments
        attachments = work.write(self.attachments(parts).drop("payload"), "attachments")
        crowded = attachments.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > limit).groupBy("email_id").agg(F.max("n").alias("n"))
        crowded = work.write(crowded, "crowded")
        if crowded.limit(1).count():
            parts, attachments = (t.join(crowded.select("email_id"), "email_id", "left_anti") for t in (parts, attachments))
        crowded = crowded.select("email_id", F.lit("SecurityViolationError").alias("type"), F.concat(F.lit("SecurityViolationError: Attachment count "), F.col("n").cast("string"), F.lit(f" exceeds limit {limit}")).alias("error"))
        bad = bad.unionByName(crowded).select("email_id", errors.error(F.col("type"), F.substring_index("error", ": ", -1)).alias("error"))
        layers, images = work.write(self.layers(parts), "layers"), work.write(self.images(parts).drop("payload"), "images")
        found = work.write(resolved(self.layer_urls(layers, attachments, images), self.options), "urls")
        references = relate.nested_references(layers, attachments)
        exact = relate.exact_references(layers)
        if self.options.modes.relations == "exact":
            parents = exact
        else:  # the first-deeper rule overwrites what lineage set
            by_rule = relate.parent_references(references)
            parents = by_rule.unionByName(exact.join(by_rule, KEY, "left_anti"))
        return Parsed(all_parts, bad, layers, attachments, images, found, references, work.write(parents, "parents"), work)


def build_engine(spark: SparkSession, options: EngineOptions | None = None) -> Engine:
    return Engine(spark, options)
