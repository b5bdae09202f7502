"""Options of the engine: frozen values with checked ranges, from code, from the environment or from a Spark session."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "1", "yes", "on")


@dataclass(frozen=True)
class Ocr:
    enabled: bool = True
    tesseract_cmd: str | None = None
    config_options: str = "--psm 6"
    timeout_seconds: int = 30
    max_image_size_mb: int = 10


@dataclass(frozen=True)
class Urls:
    enable_expansion: bool = True
    expansion_timeout: int = 5
    max_redirects: int = 10
    batch_delay: float = 0.5
    skip_image_urls: bool = True
    user_agent: str = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36"


@dataclass(frozen=True)
class Security:
    max_file_size_mb: int = 50
    max_nested_depth: int = 10
    max_attachments: int = 100
    #: Suffixes, and types whose text can be extracted.
    suspicious_extensions: tuple[str, ...] = (".exe", ".scr", ".bat", ".cmd", ".com", ".pif", ".vbs", ".js", ".jar", ".zip", ".rar", ".7z", ".ace", ".arj", ".cab", ".lzh", ".tar", ".gz")
    text_extractable_types: tuple[str, ...] = (
        "application/pdf",
        "text/plain",
        "text/html",
        "text/csv",
        "application/rtf",
        "application/msword",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/vnd.ms-excel",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    )


@dataclass(frozen=True)
class Processing:
    enable_deduplication: bool = True
    enable_enhanced_carrier_detection: bool = True
    aggressive_html_cleaning: bool = True
    preserve_excel_images: bool = True
    max_ocr_text_length: int = 10_000
    max_body_text_length: int = 50_000
    max_html_text_length: int = 5_000
    include_html_in_response: bool = True
    html_truncation_suffix: str = "...[truncated]"
    html_truncation_percentage: float = 0.1


@dataclass(frozen=True)
class Logging:
    level: str = "INFO"
    enable_azure_insights: bool = False
    log_attachments: bool = True
    log_urls: bool = True
    max_log_message_length: int = 1000


@dataclass(frozen=True)
class Modes:
    """Where the engine lets one choose between literal and intended behaviour."""

    vendor_headers: str = "intended"
    body_scope: str = "walk"
    relations: str = "first_deeper"
    recursive_eml: bool = False


@dataclass(frozen=True)
class EngineOptions:
    """All options, and the callables that an installation may supply: ocr(bytes) -> text, resolver(url) -> url,
    and extractors by content type (bytes -> text, and bytes -> named images). Each runs in Arrow batches on the executors.
    """

    ocr: Ocr = field(default_factory=Ocr)
    urls: Urls = field(default_factory=Urls)
    security: Security = field(default_factory=Security)
    processing: Processing = field(default_factory=Processing)
    logging: Logging = field(default_factory=Logging)
    modes: Modes = field(default_factory=Modes)
    ocr_reader: Callable[[bytes], str] | None = None
    url_resolver: Callable[[str], str] | None = None
    text_extractors: Mapping[str, Callable[[bytes], str]] = field(default_factory=dict)
    image_extractors: Mapping[str, Callable[[bytes], list[tuple[str, bytes]]]] = field(default_factory=dict)

    def problems(self) -> list[str]:
        """What is out of range, in words."""
        positive = {
            "max_file_size_mb": self.security.max_file_size_mb,
            "max_nested_depth": self.security.max_nested_depth,
            "max_attachments": self.security.max_attachments,
            "OCR timeout_seconds": self.ocr.timeout_seconds,
            "OCR max_image_size_mb": self.ocr.max_image_size_mb,
            "URL expansion_timeout": self.urls.expansion_timeout,
            "URL max_redirects": self.urls.max_redirects,
            "max_ocr_text_length": self.processing.max_ocr_text_length,
            "max_body_text_length": self.processing.max_body_text_length,
        }
        out = [f"{name} must be positive" for name, value in positive.items() if value <= 0]
        return out + (["URL batch_delay cannot be negative"] if self.urls.batch_delay < 0 else [])

    def validate(self) -> EngineOptions:
        if found := self.problems():
            raise ValueError(f"Configuration validation failed: {'; '.join(found)}")
        return self

    def describe(self) -> dict:
        """The plain options, for status documents."""
        return {f.name: asdict(getattr(self, f.name)) for f in fields(self) if f.name in ("ocr", "urls", "security", "processing", "logging", "modes")}


#: Environment variable: (group, option).
VARIABLES = {
    "PARSER_OCR_ENABLED": ("ocr", "enabled"),
    "PARSER_TESSERACT_CMD": ("ocr", "tesseract_cmd"),
    "PARSER_OCR_CONFIG": ("ocr", "config_options"),
    "PARSER_OCR_TIMEOUT": ("ocr", "timeout_seconds"),
    "PARSER_OCR_MAX_SIZE_MB": ("ocr", "max_image_size_mb"),
    "PARSER_URL_EXPANSION_ENABLED": ("urls", "enable_expansion"),
    "PARSER_URL_TIMEOUT": ("urls", "expansion_timeout"),
    "PARSER_URL_MAX_REDIRECTS": ("urls", "max_redirects"),
    "PARSER_URL_BATCH_DELAY": ("urls", "batch_delay"),
    "PARSER_URL_SKIP_IMAGES": ("urls", "skip_image_urls"),
    "PARSER_URL_USER_AGENT": ("urls", "user_agent"),
    "PARSER_MAX_FILE_SIZE_MB": ("security", "max_file_size_mb"),
    "PARSER_MAX_NESTED_DEPTH": ("security", "max_nested_depth"),
    "PARSER_MAX_ATTACHMENTS": ("security", "max_attachments"),
    "PARSER_DEDUPLICATION_ENABLED": ("processing", "enable_deduplication"),
    "PARSER_ENHANCED_CARRIER_DETECTION": ("processing", "enable_enhanced_carrier_detection"),
    "PARSER_AGGRESSIVE_HTML_CLEANING": ("processing", "aggressive_html_cleaning"),
    "PARSER_PRESERVE_EXCEL_IMAGES": ("processing", "preserve_excel_images"),
    "PARSER_MAX_OCR_TEXT_LENGTH": ("processing", "max_ocr_text_length"),
    "PARSER_MAX_BODY_TEXT_LENGTH": ("processing", "max_body_text_length"),
    "PARSER_MAX_HTML_TEXT_LENGTH": ("processing", "max_html_text_length"),
    "PARSER_INCLUDE_HTML_IN_RESPONSE": ("processing", "include_html_in_response"),
    "PARSER_HTML_TRUNCATION_SUFFIX": ("processing", "html_truncation_suffix"),
    "PARSER_HTML_TRUNCATION_PERCENTAGE": ("processing", "html_truncation_percentage"),
    "PARSER_LOG_LEVEL": ("logging", "level"),
    "PARSER_AZURE_INSIGHTS_ENABLED": ("logging", "enable_azure_insights"),
    "PARSER_LOG_ATTACHMENTS": ("logging", "log_attachments"),
    "PARSER_LOG_URLS": ("logging", "log_urls"),
    "PARSER_MAX_LOG_LENGTH": ("logging", "max_log_message_length"),
}


def coerce(value: str, default):
    """A variable's value in the type of its default; what can't be read gives the default."""
    if isinstance(default, bool):
        return value.lower() in TRUE_WORDS
    try:
        return type(default)(value) if isinstance(default, int | float) else value
    except ValueError:
        return default


def options_from(environment: Mapping[str, str] | None = None, fallback: bool = False) -> EngineOptions:
    """Options from environment variables; out of range, an error or (fallback) the defaults."""
    environment = os.environ if environment is None else environment
    base, groups = EngineOptions(), {}
    for name, (group, option) in VARIABLES.items():
        default = getattr(getattr(base, group), option)
        if name in environment:
            value = coerce(environment[name], default)
            groups.setdefault(group, {})[option] = value.upper() if name == "PARSER_LOG_LEVEL" else value
    kinds = {"ocr": Ocr, "urls": Urls, "security": Security, "processing": Processing, "logging": Logging}
    out = EngineOptions(**{g: kinds[g](**v) for g, v in groups.items()})
    return EngineOptions() if fallback and out.problems() else out.validate()


def to_bool(value: Column, default: bool) -> Column:
    """The same coercions over a column of settings."""
    return F.when(value.isNull(), F.lit(default)).otherwise(F.lower(value).isin(*TRUE_WORDS))


def to_int(value: Column, default: int) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(default))


def to_float(value: Column, default: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))
