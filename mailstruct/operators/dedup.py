"""First-wins deduplication as windows: layers, links, images and attachments, all within an e-mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Order of a layer's sources of links.
URL_SOURCES = ("body_text", "image_ocr", "attachment_text")


def first_of(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key in the given order, which must tell all rows of a key apart."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def layer_key(message_id: Column, signature: Column) -> Column:
    """The message id if there is one, else the signature: the id is part of the signature, so it decides alone."""
    return F.coalesce(F.nullif(message_id, F.lit("")), signature)


def distinct_layers(layers: DataFrame) -> DataFrame:
    """layers (email_id, visit_seq, message_id, signature, ...) without later ones of the same identity."""
    keyed = layers.withColumn("_key", layer_key(F.col("message_id"), F.col("signature")))
    return first_of(keyed, ["email_id", "_key"], ["visit_seq"]).drop("_key")


def source_rank(source: Column) -> Column:
    out = None
    for i, name in enumerate(URL_SOURCES):
        out = F.when(source == name, F.lit(i)) if out is None else out.when(source == name, F.lit(i))
    return out.otherwise(F.lit(0))


def consolidated_urls(urls: DataFrame) -> DataFrame:
    """urls (email_id, layer_seq, source, pos, original_url, ...): each link of an e-mail where it is seen first."""
    return first_of(urls.where("original_url <> ''"), ["email_id", "original_url"], ["layer_seq", source_rank(F.col("source")), "pos"])


def image_key(filename: Column, size: Column) -> Column:
    """Name and size in one text; deliberately as ambiguous as that."""
    return F.concat_ws("_", F.coalesce(filename, F.lit("")), F.coalesce(size, F.lit(0)).cast("string"))


def consolidated_images(images: DataFrame) -> DataFrame:
    """images (email_id, layer_seq, embedded, idx, filename, size, ...): a layer's own before those in its attachments."""
    keyed = images.withColumn("_key", image_key(F.col("filename"), F.col("size")))
    return first_of(keyed, ["email_id", "_key"], ["layer_seq", "embedded", "idx"]).drop("_key")


def consolidated_attachments(attachments: DataFrame) -> DataFrame:
    """attachments (email_id, layer_seq, idx, sha256, ...): each content once, and where it probably leads."""
    kept = first_of(attachments.where("sha256 <> ''"), ["email_id", "sha256"], ["layer_seq", "idx"])
    return kept.withColumn("leads_to_layer", F.when(F.col("is_nested_email"), F.col("layer_depth") + 1))


def unseen(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key an earlier corpus hasn't seen."""
    return rows.join(seen.select(*key).distinct(), key, "left_anti")
