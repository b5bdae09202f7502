"""Responses: a nested result for each e-mail, in four formats, as JSON with nulls kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstruct.functions import urls
from mailstruct.operators import dedup, relate, summary
from mailstruct.plans.engine import KEY, Parsed

FORMATS = ("summary", "detailed", "llm_optimized", "standard")
#: Fixed values of the result document.
FEATURES = ("pure_structural_representation", "consolidated_content_tracking", "provenance_preservation", "no_analytical_judgments")
VERSION, PURPOSE, ARCHITECTURE = "2.0", "structural_email_analysis", "2.0_enhanced_consolidated"
ENVELOPE_VERSION, ENVELOPE_ARCHITECTURE = "2.0.0", "enhanced_structural_representation"


def json_of(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def preview(body: Column) -> Column:
    return F.when(F.char_length(body) > 500, F.concat(F.left(body, F.lit(500)), F.lit("..."))).otherwise(body)


def threat_layer(layer: Column) -> Column:
    """What a language model needs of a layer that is no carrier."""
    nested = F.concat(F.lit("Nested in layer "), layer["parent_depth"].cast("string"), F.lit(" via "), F.coalesce(layer["parent_via"], F.lit("None")))
    return F.struct(
        layer["layer_depth"].alias("layer_depth"), F.left(layer["subject"], F.lit(100)).alias("subject"), F.left(layer["from_addr"], F.lit(50)).alias("from"),
        preview(layer["final_text"]).alias("body_preview"), layer["attachments"].alias("attachment_count"), layer["urls"].alias("url_count"), layer["images"].alias("image_count"),
        F.when(layer["parent_depth"].isNotNull(), nested).alias("source"),
    )


def url_provenance(url: Column, shortened: Column, layer: Column, source: Column, context: Column, attachment: Column, image: Column) -> Column:
    """A link with where it was found; all provenance is null for a link without a layer."""
    there = layer.isNotNull()
    pick = lambda c: F.when(there & (c != ""), c)
    return F.struct(
        url.alias("url"), shortened.alias("is_shortened"), layer.alias("found_in_layer"), F.when(there, source).otherwise("unknown").alias("source_type"), F.when(there, context).alias("context"),
        pick(attachment).alias("found_in_attachment"), pick(image).alias("found_in_image"), F.when(pick(image).isNotNull(), F.lit("url_in_image")).alias("threat_pattern"),
    )


def described_layers(parsed: Parsed) -> DataFrame:
    """layers with counts of children and references, and the parent's depth and file."""
    tables = {"attachments": parsed.attachments, "images": parsed.images, "urls": parsed.urls, "nested_refs": parsed.references.select("email_id", F.col("parent_seq").alias("layer_seq"))}
    rows = None
    for name, t in tables.items():
        one = t.select(*KEY, F.lit(name).alias("kind"))
        rows = one if rows is None else rows.unionAll(one)
    counts = rows.groupBy(*KEY).agg(*(F.count_if(F.col("kind") == n).alias(n) for n in tables))
    parents = parsed.parents.select(*KEY, "parent_depth", F.col("via_attachment").alias("parent_via"))
    out = parsed.layers.join(counts, KEY, "left").fillna(0, list(tables)).join(parents, KEY, "left")
    return out.withColumn("has_parent", F.col("parent_depth").isNotNull())


def all_urls(parsed: Parsed) -> DataFrame:
    """Links of layers, images and attachments, in the order in which a layer's first sight of a link is sought."""
    none, here = F.lit(None).cast("string"), ["original_url", urls.is_shortened(F.col("original_url")).alias("is_shortened"), F.lit("Not Applicable").alias("expanded_url")]
    place = F.col("idx").cast("long") * (1 << 32) + F.col("at")
    layers = parsed.urls.select(*KEY, "layer_depth", "pos", "original_url", "is_shortened", "expanded_url", "source", "context_snippet", none.alias("attachment"), none.alias("image"))
    images = parsed.images.select(*KEY, "layer_depth", "idx", "filename", "ocr_text", F.posexplode("urls_from_ocr").alias("at", "original_url"))
    text = F.when(F.char_length("ocr_text") > 100, F.concat(F.left("ocr_text", F.lit(100)), F.lit("..."))).otherwise(F.col("ocr_text"))
    images = images.select(*KEY, "layer_depth", place.alias("pos"), *here, F.lit("image_ocr").alias("source"), text.alias("context_snippet"), none.alias("attachment"), F.col("filename").alias("image"))
    files = parsed.attachments.select(*KEY, "layer_depth", "idx", "filename", "content_type", F.posexplode("urls").alias("at", "original_url"))
    found = F.concat(F.lit("Found in "), F.coalesce("content_type", F.lit("unknown")), F.lit(" attachment"))
    files = files.select(*KEY, "layer_depth", place.alias("pos"), *here, F.lit("attachment_text").alias("source"), found.alias("context_snippet"), F.col("filename").alias("attachment"), none.alias("image"))
    return layers.unionAll(images).unionAll(files)


def all_images(parsed: Parsed) -> DataFrame:
    """Images of layers, and those within their attachments."""
    own = ["filename", "content_type", "size", "ocr_text", "urls_from_ocr"]
    layers = parsed.images.select(*KEY, "layer_depth", F.col("idx").cast("long").alias("idx"), *own, F.lit(False).alias("embedded"), F.lit(None).cast("string").alias("attachment"))
    files = parsed.attachments.select(*KEY, "layer_depth", "idx", F.col("filename").alias("attachment"), F.posexplode("embedded_images").alias("at", "image"))
    place = F.col("idx").cast("long") * (1 << 32) + F.col("at")
    files = files.select(*KEY, "layer_depth", place.alias("idx"), "image.filename", F.lit("").alias("content_type"), "image.size", "image.ocr_text", "image.urls_from_ocr", F.lit(True).alias("embedded"), "attachment")
    return layers.unionAll(files)


def consolidated(parsed: Parsed) -> dict[str, DataFrame]:
    return {
        "urls": dedup.consolidated_urls(all_urls(parsed)),
        "images": dedup.consolidated_images(all_images(parsed)),
        "attachments": dedup.consolidated_attachments(parsed.attachments),
    }


def results(parsed: Parsed) -> DataFrame:
    """email_id, and the parts of its result: summaries, layers and consolidated content. Layers are grouped once."""
    layers = described_layers(parsed)
    own = F.struct("layer_depth", F.col("is_carrier").alias("is_carrier_email"), F.col("vendor").alias("carrier_vendor"), "carrier", "carrier_summary", "subject", "from_addr", "to", "cc", "bcc", "date", "message_id", "reply_to", "return_path", "received", F.map_entries("x_headers").alias("x_headers"), "plain_text", "html_text", "converted_text", "final_text", "has_html", "has_plain", "wrapper_content", "quoted_content_preview", "content_summary", "attachments", "images", "urls", "parent_depth", "parent_via")
    detail = layers.select("*", F.col("carrier.type").alias("type"), F.col("carrier.confidence").alias("confidence"), F.col("carrier.detection_method").alias("detection_method"))
    # maps have no order, so they wait as entries while the list is sorted
    out = detail.groupBy("email_id").agg(*summary.structure_of(), *summary.types_of(), *summary.carriers_of(), *summary.chain_of("parent_via"), summary.ordered(own, "layer_seq").alias("layers"))
    out = out.withColumn("layers", F.transform("layers", lambda x: x.withField("x_headers", F.map_from_entries(x["x_headers"]))))
    once = consolidated(parsed)
    found = F.struct(F.col("layer_depth").alias("layer"), "source", "context_snippet", F.col("attachment").alias("attachment_filename"), F.col("image").alias("image_filename"))
    url = F.struct("original_url", "is_shortened", "expanded_url", "source", found.alias("found_in"))
    path = F.when(F.col("embedded"), F.array(F.concat(F.lit("layer_"), F.col("layer_depth").cast("string"), F.lit("_attachment")), F.coalesce("attachment", F.lit("unknown")), F.lit("embedded_image")))
    image = F.struct(F.when(F.col("embedded"), F.col("idx") % (1 << 32)).otherwise(F.col("idx")).alias("index"), "filename", "content_type", "size", "ocr_text", "urls_from_ocr", F.col("layer_depth").alias("layer"), F.when(F.col("embedded"), "embedded_image").otherwise("direct_image").alias("source"), "attachment", path.alias("parent_chain"))
    attachment = F.struct(F.col("idx").alias("index"), "filename", "content_type", "size", "sha256", "extension", "is_nested_email", "is_suspicious_extension", "leads_to_layer", F.col("layer_depth").alias("layer"))
    chains = relate.content_chains(layers.select(*KEY, "layer_depth", "parent_depth", F.col("parent_via").alias("via_attachment")), parsed.attachments.where(F.size("embedded_images") > 0))
    lists = {"all_urls": (once["urls"], url, ("layer_seq", "pos")), "all_images": (once["images"], image, ("layer_seq", "embedded", "idx")), "all_attachments": (once["attachments"], attachment, ("layer_seq", "idx")), "content_chains": (chains, F.struct("type", "chain", "complexity_indicators"), ("layer_seq", "idx", "image_idx", "url_idx"))}
    for name, (rows, value, order) in lists.items():
        # a layer's source comes before the place there
        order = ("layer_seq", dedup.source_rank(F.col("source")).alias("rank"), "pos") if name == "all_urls" else order
        grouped = rows.groupBy("email_id").agg(summary.ordered(value, *order).alias(name))
        out = out.join(grouped, "email_id", "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out


def structure(r=F.col) -> Column:
    return F.struct(*(r(c).alias(c) for c in ("total_layers", "total_attachments", "total_images", "total_urls", "has_nested_emails", "nesting_chain", "layer_types")))


def carriers() -> Column:
    return F.struct("total_carriers", "carrier_details", "non_carrier_layers")


def all_content() -> Column:
    return F.struct("all_urls", "all_images", "all_attachments", "content_chains")


def body_of(name: str) -> Column:
    """The data of one format; an unknown name gives the standard one."""
    info = F.struct(F.lit(VERSION).alias("version"), F.lit(PURPOSE).alias("purpose"), F.array(*(F.lit(x) for x in FEATURES)).alias("features"))
    if name == "summary":
        counts = F.struct(F.size("all_urls").alias("total_urls"), F.size("all_images").alias("total_images"), F.size("all_attachments").alias("total_attachments"), F.size("content_chains").alias("content_chains"))
        return F.struct(structure().alias("structural_summary"), carriers().alias("carrier_analysis"), counts.alias("consolidated_content_counts"))
    if name == "detailed":
        meta = F.struct(F.size("layers").alias("layers_processed"), F.lit(ARCHITECTURE).alias("architecture_version"))
        return F.struct(info.alias("parser_info"), "layers", all_content().alias("consolidated_content"), structure().alias("structural_summary"), carriers().alias("carrier_analysis"), meta.alias("processing_metadata"))
    if name == "llm_optimized":
        threats = F.transform(F.filter("layers", lambda x: ~x["is_carrier_email"]), lambda x: threat_layer(x.withField("parent_via", x["parent_via"])))
        found = F.transform("all_urls", lambda u: url_provenance(u["original_url"], u["is_shortened"], u["found_in"]["layer"], u["found_in"]["source"], u["found_in"]["context_snippet"], u["found_in"]["attachment_filename"], u["found_in"]["image_filename"]))
        patterns = F.transform("content_chains", lambda c: F.struct(c["type"].alias("pattern_type"), c["complexity_indicators"].alias("complexity_indicators"), summary.chain_text(c["chain"]).alias("chain_description")))
        return F.struct(
            F.struct("total_layers", "nesting_chain", "layer_types").alias("email_structure"),
            F.struct(threats.alias("primary_threat_layers"), found.alias("all_urls_with_provenance"), patterns.alias("suspicious_content_patterns")).alias("threat_content"),
            F.struct("total_carriers", "carrier_details", F.when(F.size("carrier_details") > 0, F.element_at("carrier_details", 1)).alias("submission_method")).alias("carrier_context"),
        )
    return F.struct(structure().alias("structural_summary"), "layers", all_content().alias("consolidated_content"), carriers().alias("carrier_analysis"))


def responses(parsed: Parsed, name: str = "standard") -> DataFrame:
    """email_id, status and the JSON response of every e-mail, failed ones included. No time of day is in it."""
    meta = F.struct(F.lit(ENVELOPE_VERSION).alias("parser_version"), F.lit(ENVELOPE_ARCHITECTURE).alias("architecture"), "total_layers", "total_attachments", "total_urls")
    good = results(parsed).select("email_id", F.lit(200).alias("status"), json_of(F.struct(F.lit(True).alias("success"), body_of(name).alias("data"), meta.alias("metadata"))).alias("response"))
    bad = parsed.errors.select("email_id", F.col("error.code").alias("status"), json_of(F.struct(F.lit(False).alias("success"), F.col("error"))).alias("response"))
    return good.unionByName(bad)


def batch_response(answers: DataFrame) -> DataFrame:
    """One row for a batch of responses (email_id, status, response): counters and the share of successes."""
    return summary.batch_summary(answers.select((F.col("status") == 200).alias("success")))


def health(options) -> dict:
    """A status document; no Spark job runs."""
    return {"status": "healthy", "parser_version": ENVELOPE_VERSION, "architecture": ENVELOPE_ARCHITECTURE, "configuration": options.describe()}
