"""Links as column expressions: extraction, cleaning, shorteners, wrapped links and context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailstruct.functions.text import empty, let, strip

# The link pattern, punctuation that doesn't end a link, shorteners and image suffixes.
URL = r"""https?://[^\s<>"{}|\\^`\[\]]+|www\.[^\s<>"{}|\\^`\[\]]+"""
TRAILING, TRAILING_CLEAN = ".,;:!?)]}", ".,;:!?)]}'\""
SHORTENERS = ("bit.ly", "t.co", "goo.gl", "ow.ly", "tinyurl.com", "is.gd", "tiny.cc", "rb.gy", "short.io", "aka.ms")
MORE_SHORTENERS = (
    "bit.ly", "t.co", "goo.gl", "ow.ly", "tinyurl.com", "is.gd", "buff.ly", "rebrandly.com", "cutt.ly", "bl.ink", "snip.ly",
    "su.pr", "lnkd.in", "fb.me", "cli.gs", "sh.st", "mcaf.ee", "yourls.org", "v.gd", "s.id", "t.ly", "tiny.cc", "qlink.me",
    "po.st", "short.io", "shorturl.at", "aka.ms", "tr.im", "bit.do", "git.io", "adf.ly", "qr.ae", "tny.im",
)
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".tiff")
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*:"
#: Characters on either side of a link in its context.
AROUND = 50


def extract(text: Column) -> Column:
    """All links of a text in order, without trailing punctuation."""
    found = F.regexp_extract_all(empty(text), F.lit(f"(?iU){URL}"), F.lit(0))
    return F.transform(found, lambda u: F.rtrim(u, F.lit(TRAILING)))


def host(url: Column) -> Column:
    """The authority in lower case, with port and user, as written; empty without one."""
    return F.lower(F.regexp_extract(empty(url), rf"^(?:{SCHEME})?//([^/?#]*)", 1))


def path(url: Column) -> Column:
    """The path without the last segment's parameters."""
    return F.regexp_replace(F.regexp_extract(empty(url), rf"^(?:{SCHEME})?(?://[^/?#]*)?([^?#]*)", 1), ";[^/]*$", "")


def of_domain(url: Column, domains: Sequence[str]) -> Column:
    """Whether the host is one of the domains or lies below one."""

    def one_of(name: Column) -> Column:
        out = name.isin(*domains)
        for d in domains:
            out = out | name.endswith("." + d)
        return out

    return let(host(url), one_of)


def is_shortened(url: Column) -> Column:
    return of_domain(url, SHORTENERS)


def is_probably_shortened(url: Column) -> Column:
    """The wider list, or a short path of one alphanumeric segment."""
    p = path(url)
    return of_domain(url, MORE_SHORTENERS) | ((F.char_length(p) <= 10) & p.rlike(r"^/[a-zA-Z0-9]+\z"))


def is_image(url: Column) -> Column:
    return F.lower(path(url)).rlike("(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + r")\z")


def clean(url: Column) -> Column:
    """Without trailing punctuation; an absolute link also gets its scheme in lower case and loses empty parts."""
    url = F.rtrim(url, F.lit(TRAILING_CLEAN))
    scheme = F.regexp_extract(url, rf"^({SCHEME})", 1)
    tidy = F.concat(F.lower(scheme), F.substr(url, F.char_length(scheme) + 1))
    for pattern, into in ((r"#$", ""), (r"\?(#|$)", "$1"), (r";(\?|#|$)", "$1")):
        tidy = F.regexp_replace(tidy, pattern, into)
    return F.when((F.char_length(scheme) > 0) & (F.char_length(host(url)) > 0), tidy).otherwise(url)


def parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter that isn't blank, decoded; null without one."""
    query = F.regexp_extract(empty(url), r"^[^?#]*\?([^#]*)", 1)
    value = F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(value), value)


def unwrap_safelink(url: Column) -> Column:
    return F.coalesce(parameter(url, "url"), parameter(url, "target"), url)


def unwrap_defense(url: Column) -> Column:
    """The u parameter, decoded twice; a plus sign survives the second time."""
    once = parameter(url, "u")
    return F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once, url)


def context(text: Column, url: Column, around: int = AROUND) -> Column:
    """The text about a link's first occurrence, with ellipses at both ends if either is cut; empty if it doesn't occur."""

    def cut(at: Column) -> Column:
        start, end = F.greatest(F.lit(0), at - around), F.least(F.char_length(text), at + F.char_length(url) + around)
        inner = strip(F.substr(text, start + 1, end - start))
        there = (F.char_length(empty(text)) > 0) & (F.char_length(empty(url)) > 0) & (at >= 0)
        return F.when(there, F.when((start > 0) | (end < F.char_length(text)), F.concat(F.lit("..."), inner, F.lit("..."))).otherwise(inner)).otherwise(F.lit(""))

    return let(F.instr(text, url) - 1, cut)


def process(urls: Column) -> Column:
    """Each different link once, in order of first sight, with its flag and an expansion to be filled in."""
    return F.transform(F.array_distinct(urls), lambda u: F.struct(u.alias("original_url"), is_shortened(u).alias("is_shortened"), F.lit("Not Applicable").alias("expanded_url")))


def expand(urls: DataFrame, known: DataFrame) -> DataFrame:
    """urls (original_url, is_shortened, ...) with expanded_url from known (short, long); only shortened links are looked up,
    and a link that stays as it is remains 'Not Applicable'. No link is fetched. known has one row for each short link.
    """
    found = urls.drop("expanded_url").join(known.select(F.col("short"), F.col("long")), (F.col("original_url") == F.col("short")) & F.col("is_shortened"), "left")
    changed = F.col("long").isNotNull() & (F.col("long") != F.col("original_url"))
    return found.withColumn("expanded_url", F.when(changed, F.col("long")).otherwise(F.lit("Not Applicable"))).drop("short", "long")
