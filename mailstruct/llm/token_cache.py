"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer version digest, content digest, token count). A run joins the digests of its
documents to it, sends only distinct misses to the tokenizer, and appends their counts. Content is normalised before it
is digested in so far as the tokenizer provably ignores the difference: runs of white space become one space if its
splitter drops white space, and nothing changes otherwise.

Joins are of slim rows. A text moves only if its digest may occur again, or, with a cache that has counts, if it may be
missing there, both by bitmaps of fixed size; a text that occurs once is encoded where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstruct.llm import tokens
from mailstruct.llm.common import Workspace, exists, maybe_among, table, text_of

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def normalised(text: Column, tokenizer: str) -> Column:
    """The text as it is digested: equal results have equal ids."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")) if tokens.drops_space(tokenizer) else text


def counter(tokenizer: str, version: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        for batch in batches:
            found = encode.counts(batch.column("content"))
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(found)), batch.column("digest"), pa.array(found, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    return count


def fill_cache(texts: DataFrame, digests: DataFrame, cache: str, tokenizer: str, work: Workspace) -> DataFrame:
    """Appends the counts of distinct misses to the cache, and returns its rows for this tokenizer version.

    texts: digest, content; digests: the digests of the same rows, written. A digest that fills a third of all rows is
    reduced to one row before any shuffle.
    """
    spark = texts.sparkSession
    version = tokens.tokenizer_version(tokenizer)
    missing = digests.groupBy("digest").agg(F.count("*").alias("rows"))
    if exists(spark, cache):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).select("digest")
        if known.limit(1).count():
            missing = work.write(missing.join(known.distinct(), "digest", "left_anti"), "missing")
            if not missing.limit(1).count():
                return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
            texts = maybe_among(F.col("digest"), missing)(texts).where("maybe").drop("maybe").join(missing.select("digest").hint("merge"), "digest", "left_semi")
    again = work.write(missing.where("rows > 1").select("digest"), "again")
    marked = maybe_among(F.col("digest"), again)(texts)
    once = marked.where(~F.col("maybe")).select("digest", "content")
    distinct = once.unionAll(marked.where("maybe").groupBy("digest").agg(F.first("content").alias("content")))
    distinct.mapInArrow(counter(tokenizer, version), CACHE_SCHEMA).write.mode("append").option("compression", "zstd").parquet(cache)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    cache is the path of the table of counts, which later runs read and append to. Null and empty texts have 0 tokens; very
    long texts are encoded whole; repeated rows each keep theirs; an empty table gives an empty result. Columns of docs named
    like the new ones are replaced.
    """
    work = Workspace(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit", "digest", "content")]
    content = normalised(text_of(text), tokenizer)
    digested = docs.select(*keep, F.octet_length(text_of(text)).cast("long").alias("n_bytes"), content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    slim = work.write(digested.drop("content"), "digested")
    counts = fill_cache(digested.select("digest", "content"), slim.select("digest"), cache, tokenizer, work)
    # two runs that fill one cache at a time may append a digest twice; written, so that the join meets two plain shuffles
    # and Spark can split a digest that fills many rows
    counts = work.write(counts.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")), "counts")
    return slim.join(counts, "digest", "left").select(*keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_digest_cache(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """With the path of a cache, only what earlier runs have not counted there is encoded; without, the run starts a new one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, cache or Workspace(spark).path("token_cache"))
