"""Aggregates of an e-mail's layers: counts, descriptors, carriers and the nesting chain, in list order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(value: Column, *order: str) -> Column:
    """An ordered list of a group's values; nulls are left out."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("_value")))))
    return F.transform(rows, lambda r: r["_value"])


def structure_of() -> list[Column]:
    """Aggregates of layers: layer_seq, layer_depth, attachments, images, urls (counts)."""
    return [
        F.count("*").alias("total_layers"),
        F.sum("attachments").alias("total_attachments"),
        F.sum("images").alias("total_images"),
        F.sum("urls").alias("total_urls"),
        F.bool_or(F.col("layer_depth") > 0).alias("has_nested_emails"),
    ]


def structural_summary(layers: DataFrame) -> DataFrame:
    return layers.groupBy("email_id").agg(*structure_of())


def types_of() -> list[Column]:
    """Aggregates of layers: layer_seq, layer_depth, is_carrier, vendor, nested_refs, has_parent, content_summary."""
    value = F.struct(
        F.col("layer_depth").alias("layer"),
        F.when(F.col("is_carrier"), "carrier").otherwise("content").alias("type"),
        "vendor",
        (F.col("nested_refs") > 0).alias("has_nested_refs"),
        F.col("has_parent").alias("has_parent_ref"),
        "content_summary",
    )
    return [ordered(value, "layer_seq").alias("layer_types")]


def layer_types(layers: DataFrame) -> DataFrame:
    return layers.groupBy("email_id").agg(*types_of())


def carriers_of() -> list[Column]:
    """Aggregates of layers: layer_seq, layer_depth, is_carrier, vendor, carrier_summary, type, confidence, detection_method."""
    value = F.struct(F.col("layer_depth").alias("layer"), "vendor", F.col("carrier_summary").alias("detection_summary"), "type", "confidence", "detection_method")
    return [
        F.count_if(F.col("is_carrier")).alias("total_carriers"),
        ordered(F.when(F.col("is_carrier"), value), "layer_seq").alias("carrier_details"),
        ordered(F.when(~F.col("is_carrier"), F.col("layer_depth")), "layer_seq").alias("non_carrier_layers"),
    ]


def carrier_analysis(layers: DataFrame) -> DataFrame:
    return layers.groupBy("email_id").agg(*carriers_of())


def chain_label(depth: Column, is_carrier: Column, via: Column) -> Column:
    name, at = F.lower(via), depth.cast("string")
    return (
        F.when(is_carrier, F.concat(F.lit("carrier_email_layer_"), at))
        .when(F.coalesce(via, F.lit("")) == "", F.concat(F.lit("content_layer_"), at))
        .when(name.endswith(".eml"), F.concat(F.lit("nested_eml_layer_"), at))
        .when(name.endswith(".xlsx") | name.endswith(".xls"), F.concat(F.lit("excel_attachment_layer_"), at))
        .otherwise(F.concat(F.lit("attachment_"), via, F.lit("_layer_"), at))
    )


def chain_of(via: str = "via_attachment") -> list[Column]:
    """Aggregates of layers: layer_seq, layer_depth, is_carrier, via. Depth orders, list order breaks ties."""
    return [ordered(chain_label(F.col("layer_depth"), F.col("is_carrier"), F.col(via)), "layer_depth", "layer_seq").alias("nesting_chain")]


def nesting_chain(layers: DataFrame) -> DataFrame:
    return layers.groupBy("email_id").agg(*chain_of())


def batch_summary(items: DataFrame, key: list[str] | None = None) -> DataFrame:
    """items: success (boolean). Totals and the share of successes, for each key or over all."""
    good = F.count_if(F.col("success"))
    return items.groupBy(*(key or [])).agg(F.count("*").alias("total"), good.alias("successful"), (F.count("*") - good).alias("failed"), (good / F.count("*")).alias("success_rate"))


def chain_text(chain: Column) -> Column:
    """Steps as type(value), values cut at 30 characters, joined by arrows."""
    value = lambda s: F.coalesce(s["filename"], s["value"], s["depth"].cast("string"), F.lit("unknown"))
    return F.array_join(F.transform(chain, lambda s: F.concat(s["type"], F.lit("("), F.left(value(s), F.lit(30)), F.lit(")"))), " → ")
