"""Markup to text and links, in one Arrow pass over each text.

A part's markup is parsed once: hidden subtrees are dropped, links collected, and the rest rendered as plain text with
targets after link texts. Cleaning then follows the order: entities, invisible characters, NFKC, typographic replacements,
white space, flattened links, invisible characters again.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mailstruct.functions.text import AGGRESSIVE_INVISIBLE, CONSERVATIVE_INVISIBLE, REPLACEMENTS

# Styles that hide an element, and the white space that becomes one blank.
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0|font-size\s*:\s*0|height\s*:\s*0|width\s*:\s*0", re.I)
BLANKS = re.compile("[ \t\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT = frozenset(("script", "style", "head", "title", "noscript", "template"))
# Forms in which a link may be written, which become text and target, or the target alone.
LINK_FORMS = (r"\[([^\]]+)\]\(<(https?://[^)>]+)>\)", r"\[([^\]]+)\]\((https?://[^)]+)\)", r"<(https?://[^>]+)>")
RESULT = "text string, links array<string>, has_markup boolean"


class Reader(HTMLParser):
    """Renders what is visible; all hrefs come before all srcs, as in document order of each.

    What opens with <? or <! or </ and no name is a comment up to the first >, as it is in browsers: a tag inside is none, nor is its link.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hrefs: list[str] = []
        self.srcs: list[str] = []
        self.open: list[str] = []
        self.hidden_at: list[int] = []
        self.silent = 0
        self.targets: list[tuple[int, str]] = []
        self.found = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.found = True
        named = dict(attrs)
        if tag in ("a", "link") and named.get("href") is not None:
            self.hrefs.append(named["href"])
        if tag in ("img", "script", "iframe") and named.get("src") is not None:
            self.srcs.append(named["src"])
        hidden = "hidden" in named or bool(HIDDEN.search(named.get("style") or ""))
        if tag in VOID:
            if not self.hidden_at and not self.silent and tag in ("br", "hr"):
                self.out.append("\n")
            return
        self.open.append(tag)
        if hidden:
            self.hidden_at.append(len(self.open))
        if tag in SILENT:
            self.silent += 1
        if not self.hidden_at and not self.silent:
            if tag in BLOCKS:
                self.out.append("\n\n" if tag not in ("li", "tr", "td", "th", "dt", "dd") else "\n" if tag != "td" else " ")
            if tag == "a" and (named.get("href") or "").startswith(("http://", "https://")):
                self.targets.append((len(self.open), named["href"]))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            depth, last = len(self.open), self.open.pop()
            if self.targets and self.targets[-1][0] == depth:
                _, target = self.targets.pop()
                if not self.hidden_at and not self.silent:
                    self.out.append(f" {target}")
            if last in SILENT:
                self.silent -= 1
            if self.hidden_at and self.hidden_at[-1] == depth:
                self.hidden_at.pop()
            elif not self.hidden_at and not self.silent and last in BLOCKS and last not in ("td", "th"):
                self.out.append("\n")
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.hidden_at and not self.silent:
            self.out.append(data)


class Visible(dict):
    """A table for str.translate that learns which characters stay, as it meets them."""

    def __init__(self, stays) -> None:
        super().__init__()
        self.stays = stays

    def __missing__(self, code: int) -> int | None:
        self[code] = code if self.stays(chr(code)) else None
        return self[code]


def seen_by_most(c: str) -> bool:
    return c not in CONSERVATIVE_INVISIBLE and (ord(c) >= 32 or c in "\t\n\r")


def seen_by_all(c: str) -> bool:
    if c in "\t\n\r":
        return True
    if c in AGGRESSIVE_INVISIBLE or ord(c) < 32 or 0x7F <= ord(c) <= 0x9F:
        return False
    kind = unicodedata.category(c)
    return kind not in ("Cf", "Cc", "Cs", "Co") and not (kind[0] == "M" and unicodedata.combining(c))


TABLES = {True: Visible(seen_by_all), False: Visible(seen_by_most)}


def without_invisible(text: str, aggressive: bool) -> str:
    return text if text.isascii() and text.isprintable() else text.translate(TABLES[aggressive])


def tidy(text: str) -> str:
    lines = [line.strip() for line in BLANKS.sub(" ", re.sub(r"\r\n?", "\n", text)).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def read(text: str, aggressive: bool = True) -> tuple[str, list[str], bool]:
    """(plain text, absolute links, whether there is any tag) of one text. Never raises."""
    if not text:
        return "", [], False
    reader = Reader()
    try:
        reader.feed(text)
        reader.close()
    except Exception:  # noqa: BLE001  what was read so far stands
        pass
    plain = without_invisible(html.unescape("".join(reader.out)), aggressive)
    plain = unicodedata.normalize("NFKC", plain)
    for old, new in REPLACEMENTS.items():
        plain = plain.replace(old, new)
    plain = tidy(plain)
    for pattern in LINK_FORMS[:2]:
        plain = re.sub(pattern, r"\1 \2", plain)
    plain = without_invisible(re.sub(LINK_FORMS[2], r"\1", plain), aggressive).strip()
    links = [u for u in reader.hrefs + reader.srcs if u.startswith(("http://", "https://"))]
    return plain, links, reader.found and "<" in text and bool(re.search(r"<[^>]+>", text))


def parsed(text: Column, aggressive: bool = True) -> Column:
    """struct(text, links, has_markup) of a column of markup."""

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(t or "", aggressive) for t in texts], columns=["text", "links", "has_markup"])

    return run(text)
