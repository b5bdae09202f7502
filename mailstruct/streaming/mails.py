"""Mail as a stream: the parse has no state, and corpus-wide deduplication forgets what lies behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailstruct.config import EngineOptions
from mailstruct.plans.engine import Engine


def stream_parts(mails: DataFrame, options: EngineOptions | None = None) -> DataFrame:
    """Part rows of a stream of mails (email_id, content); the same as for a table."""
    return Engine(mails.sparkSession, options).parts(mails)


def distinct_stream(mails: DataFrame, time: str = "modificationTime", late: str = "1 hour") -> DataFrame:
    """A stream without mails whose content came before within the lateness allowed."""
    marked = mails.withColumn("content_digest", F.sha2("content", 256)).withWatermark(time, late)
    return marked.dropDuplicatesWithinWatermark(["content_digest"])


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests by hour and type with the share of failures; late rows within the watermark still count."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return out.agg(F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("failed")).select(F.col("w.start").alias("start"), "event_type", "requests", "failed")
