"""Header and body text as column expressions. Patterns carry (?U) so that white space means what it means for Unicode text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest text that an image may contribute, and lines of a quoted preview.
OCR_CAP, PREVIEW_LINES, SIGNATURE_SAMPLE = 10_000, 5, 500

# Invisible characters of the two cleaning modes, and replacements of typographic characters.
CONSERVATIVE_INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\ufeff\u00ad"
AGGRESSIVE_INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0"
)
REPLACEMENTS = {
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u201a": "'", "\u201e": '"', "\u2039": "<", "\u203a": ">",
    "\u00ab": "<<", "\u00bb": ">>", "\u2013": "-", "\u2014": "--", "\u2015": "--", "\u2212": "-", "\u00a0": " ",
    "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u200a": " ", "\u202f": " ", "\u205f": " ", "\u3000": " ",
    "\u00a9": "(c)", "\u00ae": "(R)", "\u2122": "(TM)", "\u00b0": "deg", "\u00b1": "+/-", "\u00b7": "*", "\u2022": "*",
    "\u2026": "...", "\u00d7": "x", "\u00f7": "/", "\u20ac": "EUR", "\u00a3": "GBP", "\u00a5": "JPY", "\u00a2": "c",
    "\u00bc": "1/4", "\u00bd": "1/2", "\u00be": "3/4", "\u2153": "1/3", "\u2154": "2/3", "\u2032": "'", "\u2033": '"', "\u2035": "`",
}
#: Lines that can open a quoted message. A line counts only if it also names an original or forwarded message.
QUOTE_MARKS = (
    r"-----Original Message-----",
    r"Begin forwarded message:",
    r"^From:\s*.+@.+",
    r"^Sent:\s*.+",
    r"forwarded for (analysis|review)",
    r"please (analyze|check|review)",
    r"flagged as suspicious",
)
SPACE = r"[\s\x1c-\x1f]"


def empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, then) -> Column:
    """then(value), with value worked out once and written once in the plan, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def clean_header(value: Column) -> Column:
    """A header value on one line, without NULs; null and empty give the empty text."""
    value = strip(F.regexp_replace(empty(value), r"\x00+\z", ""))
    return F.translate(value, "\n\x00\r", " ")


def final_text(converted: Column, plain: Column) -> Column:
    return F.coalesce(F.nullif(converted, F.lit("")), empty(plain))


def blank_base64(plain: Column) -> Column:
    """Empty for a body that is one long run of base64 characters."""
    looks = (F.char_length(plain) > 800) & plain.rlike(r"(?U)\A[A-Za-z0-9+/=\s]{800,}\z")
    return F.when(looks, F.lit("")).otherwise(plain)


def strip_invisible(text: Column) -> Column:
    """The conservative cleaning: seven invisible characters and C0 controls other than tab and line ends."""
    return F.regexp_replace(F.translate(text, CONSERVATIVE_INVISIBLE, ""), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def replace_typographic(text: Column) -> Column:
    one = {k: v for k, v in REPLACEMENTS.items() if len(v) == 1}
    text = F.translate(text, "".join(one), "".join(one.values()))
    for k, v in REPLACEMENTS.items():
        if len(v) > 1:
            text = F.replace(text, F.lit(k), F.lit(v))
    return text


def normalize_whitespace(text: Column) -> Column:
    """Line ends as LF, runs of blanks as one, lines stripped, and at most one empty line in a row."""
    text = F.regexp_replace(text, r"\r\n|\r", "\n")
    text = F.regexp_replace(text, "[ \t\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ")
    lines = F.transform(F.split(text, "\n"), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def cap(text: Column, longest: int = OCR_CAP) -> Column:
    """The text, cut with an ellipsis beyond the longest length."""
    return F.when(F.char_length(text) > longest, F.concat(F.left(text, F.lit(longest)), F.lit("..."))).otherwise(text)


def split_wrapper(text: Column, is_carrier: Column) -> Column:
    """struct(wrapper_content, quoted_content_preview, content_summary): a carrier's own words apart from what it quotes."""
    marked = lambda line: (F.lower(line).contains("original message") | F.lower(line).contains("forwarded message")) & line.rlike("(?iU)" + "|".join(QUOTE_MARKS))
    carries = is_carrier & (F.char_length(text) > 0)

    def divided(lines: Column) -> Column:
        start = F.nullif(F.array_position(F.transform(lines, marked), True), F.lit(0)).cast("int")
        return let(start, lambda at: F.struct(strip(F.array_join(F.slice(lines, 1, at - 1), "\n")).alias("wrapper"), F.array_join(F.slice(lines, at, F.lit(PREVIEW_LINES)), "\n").alias("quoted")))

    def described(parts: Column) -> Column:
        found = carries & (F.char_length(parts["wrapper"]) > 0)
        summary = F.when(found, F.format_string("Carrier email with %d chars wrapper content", F.char_length(parts["wrapper"]))).when(
            carries, F.format_string("Carrier email with %d chars total content", F.char_length(text))
        )
        return F.struct(F.when(found, parts["wrapper"]).alias("wrapper_content"), F.when(found, parts["quoted"]).alias("quoted_content_preview"), summary.alias("content_summary"))

    # a text is split once: lines found again for each line would cost the square of a text
    return let(F.when(carries, let(F.split(text, "\n"), divided)), described)


def signature(subject: Column, from_addr: Column, date: Column, message_id: Column, body: Column) -> Column:
    """First 16 hexadecimal digits of the digest of a message's identity and the head of its body."""
    parts = [strip(empty(c)) for c in (subject, from_addr, date, message_id)]
    return F.left(F.sha2(F.concat_ws("|", *parts, F.left(empty(body), F.lit(SIGNATURE_SAMPLE))), 256), F.lit(16))


def contains_markup(text: Column) -> Column:
    """The cheap guard before a text is parsed as markup."""
    return F.coalesce(text.contains("<") & text.rlike("<[^>]+>"), F.lit(False))
