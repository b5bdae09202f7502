"""Errors as values: a struct for each e-mail, limits that produce them, and the status that each type answers with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status by exact type; every other type answers 500.
STATUS = {
    "FileProcessingError": 400,
    "EmailParsingError": 422,
    "SecurityViolationError": 413,
    "ValueError": 400,
    "FileNotFoundError": 404,
    "TimeoutError": 504,
    "ConfigurationError": 500,
    "ResourceManagementError": 507,
}
CUSTOM = ("PhishingParserError", "FileProcessingError", "EmailParsingError", "SecurityViolationError", "ConfigurationError", "ResourceManagementError", "DataValidationError", "CarrierDetectionError", "DependencyError", "OCRProcessingError", "URLProcessingError", "AttachmentProcessingError", "HTMLCleaningError")
#: Which custom type wraps a standard one, first match first. A timeout is an OSError, so it counts as a file's.
WRAPPED = (
    (("OSError", "IOError", "FileNotFoundError", "PermissionError", "TimeoutError"), "FileProcessingError"),
    (("MemoryError",), "ResourceManagementError"),
    (("ValueError", "TypeError", "UnicodeDecodeError"), "DataValidationError"),
    (("ImportError", "ModuleNotFoundError"), "DependencyError"),
)
NO_ERROR = "struct<type: string, message: string, code: int, details: string>"


def status_of(kind: Column) -> Column:
    out = None
    for name, code in STATUS.items():
        out = F.when(kind == name, F.lit(code)) if out is None else out.when(kind == name, F.lit(code))
    return out.otherwise(F.lit(500))


def wrapped(kind: Column) -> Column:
    """The custom type that an exception of this type becomes; custom types stay."""
    out = F.when(kind.isin(*CUSTOM), kind)
    for names, into in WRAPPED:
        out = out.when(kind.isin(*names), F.lit(into))
    return out.otherwise(F.lit("PhishingParserError"))


def error(kind: Column, message: Column, details: Column | None = None) -> Column:
    return F.struct(kind.alias("type"), message.alias("message"), status_of(kind).alias("code"), (F.lit(None).cast("string") if details is None else details).alias("details"))


def limit_error(what: str, value: Column, limit: int, broken: Column) -> Column:
    """A security violation where broken holds, else null."""
    message = F.concat(F.lit(f"{what} "), value.cast("string"), F.lit(f" exceeds limit {limit}"))
    return F.when(broken, error(F.lit("SecurityViolationError"), message, F.to_json(F.struct(value.alias("value"), F.lit(limit).alias("limit")))))


def size_error(size: Column, max_mb: int) -> Column:
    return limit_error("File size", size, max_mb * 1024 * 1024, size > max_mb * 1024 * 1024)


def depth_error(depth: Column, most: int) -> Column:
    return limit_error("Nesting depth", depth, most, depth > most)


def attachments_error(count: Column, most: int) -> Column:
    return limit_error("Attachment count", count, most, count > most)


def format_error(name: Column) -> Column:
    return F.when(~F.lower(name).rlike(r"\.(eml|msg)\z"), error(F.lit("FileProcessingError"), F.concat(F.lit("Unsupported file format: "), name)))


def missing_error(name: Column, there: Column) -> Column:
    return F.when(~there, error(F.lit("FileNotFoundError"), F.concat(F.lit("File not found: "), name)))


def dependency_error(name: str, there: bool) -> Column:
    return F.lit(None).cast(NO_ERROR) if there else error(F.lit("DependencyError"), F.lit(f"{name} is not installed"))
