"""Mails from requests, files and streams: tables of (email_id, content)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstruct.functions import errors
from mailstruct.sources.documents import mail_of_msg

#: Fields that may hold a mail in base64, in order; the first that is present decides, even if it is bad.
FIELDS = ("email_data", "data", "email_content")
DEFAULT_NAME = "email.eml"


def decoded(body: Column) -> Column:
    """Bytes from base64 with foreign characters left out; null if what is left is no whole base64."""
    own = F.regexp_replace(body, r"[^A-Za-z0-9+/=]", "")
    whole = own.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when(whole, F.try_to_binary(own, F.lit("base64")))


def from_json(requests: DataFrame) -> DataFrame:
    """requests with content, filename and error, from their field columns (null: the field is absent)."""
    encoded = F.coalesce(*(F.col(c) for c in FIELDS))
    out = requests.withColumn("content", decoded(encoded)).withColumn("filename", F.coalesce("filename", F.lit(DEFAULT_NAME)))
    missing, bad = encoded.isNull(), encoded.isNotNull() & F.col("content").isNull()
    kind = F.when(missing | bad, F.lit("ValueError"))
    message = F.when(missing, F.lit("JSON must contain one of: " + ", ".join(FIELDS))).when(bad, F.lit("Invalid JSON request: the field holds no base64"))
    return out.withColumn("error", F.when(kind.isNotNull(), errors.error(kind, message)))


def from_raw(requests: DataFrame) -> DataFrame:
    """requests (body binary, x_filename, qs_filename) with content, filename and error."""
    empty = F.coalesce(F.octet_length("body"), F.lit(0)) == 0
    name = F.coalesce("x_filename", "qs_filename", F.lit(DEFAULT_NAME))
    return requests.withColumn("content", F.col("body")).withColumn("filename", name).withColumn("error", F.when(empty, errors.error(F.lit("ValueError"), F.lit("Request body is empty"))))


def from_batches(batches: DataFrame, most: int = 10) -> DataFrame:
    """One row for each item of batches (batch_id, emails array<struct<...>>). An empty batch or one beyond most fails as a whole."""
    n = F.coalesce(F.size("emails"), F.lit(0))
    message = F.when(n <= 0, F.lit("'emails' must be a non-empty list")).when(n > most, F.lit(f"Batch size limited to {most} emails"))
    checked = batches.withColumn("batch_error", F.when(message.isNotNull(), errors.error(F.lit("ValueError"), message)))
    items = F.when(F.col("batch_error").isNull(), F.col("emails"))
    return checked.select("batch_id", "batch_error", F.posexplode_outer(items).alias("item", "email"))


def from_files(spark: SparkSession, path: str, pattern: str = "*.{eml,msg}") -> DataFrame:
    """email_id (a hash of the path), path, content, size of the mail files below a path; sizes are pushed to the listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("email_id"), "path", "content", F.col("length").alias("size"), errors.format_error(F.col("path")).alias("error"))


def from_stream(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """The same as an unbounded table: new files become new rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return files.select(F.xxhash64("path").alias("email_id"), "path", "modificationTime", "content", F.col("length").alias("size"))


def with_outlook(files: DataFrame) -> DataFrame:
    """files (path, content, error) with the content of .msg files as RFC 5322 bytes; a file that can't be converted gets an error."""

    @F.pandas_udf("content binary, problem string")
    def convert(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        def one(path, data):
            if not (path or "").lower().endswith(".msg"):
                return data, None
            try:
                return mail_of_msg(bytes(data)), None
            except ImportError as e:
                return None, f"DependencyError: {e}"
            except Exception as e:  # noqa: BLE001  a damaged file becomes a row
                return None, f"EmailParsingError: {e}"

        return pd.DataFrame([one(p, c) for p, c in zip(paths, contents, strict=True)], columns=["content", "problem"])

    out = files.withColumn("_c", convert("path", "content"))
    problem = F.col("_c.problem")
    found = errors.error(F.element_at(F.split(problem, ": "), 1), F.regexp_replace(problem, "^[A-Za-z]+: ", ""))
    return out.withColumn("content", F.col("_c.content")).withColumn("error", F.coalesce("error", F.when(problem.isNotNull(), found))).drop("_c")
