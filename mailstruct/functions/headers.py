"""Headers of a mail as column expressions over its bytes: nothing leaves the JVM, and a body is not looked at.

`unfolded` cuts the bytes at the first blank line and gives (name, value) pairs with folded lines joined (RFC 5322). `read` gives
values as the parser gives them: encoded words decoded (RFC 2047), addresses, dates and ids in their normal form. Each value comes with whether
this reading is certain; what is not (group addresses, comments, rare character sets, damaged words) is left to the parser, see `outer_headers`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailstruct.functions.text import let

ENTRY = "array<struct<k: string, v: string>>"
# Character sets by the names that mails use, and what windows-1252 has where ISO 8859-1 has control characters.
UTF8, LATIN, ASCII, WINDOWS = ("utf-8", "utf8"), ("iso-8859-1", "latin-1", "latin1"), ("us-ascii", "ascii"), ("windows-1252", "cp1252")
HIGH = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
HIGH_TEXT = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
UNASSIGNED = "[\x81\x8d\x8f\x90\x9d]"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
#: Headers that hold addresses, and ASCII characters that make a display name stand in quotes.
ADDRESSES, SPECIALS = ("from", "to", "cc", "bcc", "reply-to", "sender", "resent-from", "resent-to", "resent-cc", "resent-bcc", "resent-sender"), r'[()<>@,:;.\\"\[\]]'
#: Headers that are read in another way than text, and not here.
OTHERS = ("content-type", "content-disposition", "content-transfer-encoding", "mime-version", "orig-date", "resent-date")

#: To the parser an equals sign that opens the data ends the word, unless an escape follows.
WORD = r"=\?([A-Za-z0-9_-]+)(?:\*[A-Za-z0-9-]*)?\?([qQbB])\?(?!=(?![0-9A-Fa-f]{2}))([!->@-~]*)\?="
ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
SPEC = rf"{ATOM}(?:\.{ATOM})*@{ATOM}(?:\.{ATOM})*"
PLAIN_NAME, QUOTED_NAME = rf"{ATOM}(?:[ \t]+{ATOM})*", r'"[^"\\\x00-\x1f\x7f-￿]*"'
WORDS = rf"{WORD}(?:[ \t]+{WORD})*"
DATE = r"^[ \t]*(?:[A-Z][a-z]{2},[ \t]*)?(\d{1,2})[ \t]+(" + "|".join(MONTHS) + r")[ \t]+(\d{4})[ \t]+([01]\d|2[0-3]):([0-5]\d):([0-5]\d)[ \t]+([+-](?:0\d|1[0-4])[0-5]\d)[ \t]*$"


def uncaptured(pattern: str) -> str:
    """A pattern whose groups are no captures."""
    return pattern.replace("(?:", "\0").replace("(?", "\1").replace("\\(", "\2").replace("(", "(?:").replace("\0", "(?:").replace("\1", "(?").replace("\2", "\\(")


def unfolded(content: Column) -> Column:
    """(k, v) of each header in order, names as written. Lines that are no headers end the block; an envelope line, a line without
    a name and a leading continuation are left out. Bytes that are no UTF-8 become U+FFFD. Null has none."""
    text = F.coalesce(content.cast("binary").cast("string"), F.lit(""))
    for blank in ("\n\n", "\n\r", "\r\r"):
        text = F.substring_index(text, blank, 1)
    lines = F.split(F.make_valid_utf8(text), r"\r\n|\r|\n")

    def block(x: Column) -> Column:
        end = F.array_position(F.transform(x, lambda line: line.rlike(r"^(?:From |[!-9;-~]*:|[ \t])")), F.lit(False))
        return let(end, lambda n: F.when(n > 0, F.slice(x, F.lit(1), n.cast("int") - 1)).otherwise(x))

    joined = F.split(F.regexp_replace(F.array_join(let(lines, block), "\n"), r"\n(?=[ \t])", ""), "\n")
    named = F.filter(joined, lambda x: x.rlike(r"^(?!From )[!-9;-~]+:"))
    return F.transform(named, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.regexp_replace(x, r"^[^:]*:[ \t]*", "").alias("v")))


def one_of(x: Column, values: Sequence[str]) -> Column:
    return x.isin(*values)


def word_text(word: Column) -> Column:
    """The text of one encoded word; null if its character set or its coding isn't one of those known here."""

    def percent(data: Column) -> Column:
        out = F.replace(F.replace(F.replace(data, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B")), F.lit("_"), F.lit("%20"))
        return F.regexp_replace(out, "=([0-9A-Fa-f]{2})", r"%$1")

    def pairs(escaped: Column) -> Column:
        """Each high byte of a one-byte set as the two bytes of its character."""
        out = F.regexp_replace(escaped, "%([89AaBb][0-9A-Fa-f])", "\x01C2\x01$1")
        for high, low in (("Cc", "8"), ("Dd", "9"), ("Ee", "A"), ("Ff", "B")):
            out = F.regexp_replace(out, f"%[{high}]([0-9A-Fa-f])", f"\x01C3\x01{low}$1")
        return F.replace(out, F.lit("\x01"), F.lit("%"))

    def raw(data: Column) -> Column:
        whole = data.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
        return F.when(whole, F.try_to_binary(data, F.lit("base64")))

    def text(w: Column) -> Column:
        utf8 = F.when(w["quoted"], F.try_url_decode(percent(w["data"]))).otherwise(F.make_valid_utf8(raw(w["data"]).cast("string")))
        latin = F.when(w["quoted"], F.try_url_decode(pairs(percent(w["data"])))).otherwise(F.decode(raw(w["data"]), "ISO-8859-1"))
        return let(F.when(one_of(w["charset"], UTF8), utf8).otherwise(latin), lambda t: in_set(w["charset"], t))

    def in_set(charset: Column, t: Column) -> Column:
        known = F.when(one_of(charset, (*UTF8, *LATIN)), t).when(one_of(charset, WINDOWS) & ~t.rlike(UNASSIGNED), F.translate(t, HIGH, HIGH_TEXT))
        return F.when(~t.contains("\ufffd"), known.when(one_of(charset, ASCII) & ~t.rlike(r"[^\x00-\x7f]"), t))

    found = F.struct(F.lower(F.regexp_extract(word, WORD, 1)).alias("charset"), (F.lower(F.regexp_extract(word, WORD, 2)) == "q").alias("quoted"), F.regexp_extract(word, WORD, 3).alias("data"))
    return let(found, text)


def decoded_words(value: Column) -> Column:
    """A text with its encoded words decoded, and white space between two of them left out; null if there is one that can't be."""
    word = uncaptured(WORD)
    close = F.regexp_replace(value, rf"({word})[ \t]+(?={word})", "$1")
    pieces = F.regexp_extract_all(close, F.lit(rf"(?s){word}|.+?(?={word}|\z)"), F.lit(0))
    texts = F.transform(pieces, lambda p: F.when(p.rlike(rf"^{word}\z"), word_text(p)).otherwise(p))
    whole = let(texts, lambda t: F.when(~F.exists(t, lambda x: x.isNull()), F.array_join(t, "")))
    return F.when(~F.regexp_replace(value, word, "").contains("=?"), whole)


def text_value(value: Column) -> Column:
    return F.when(value.contains("=?"), decoded_words(value)).otherwise(value)


def mailbox(one: Column) -> Column:
    """`a@b`, `Name <a@b>` or `"Name" <a@b>` in normal form; null for any other."""
    bare, named = rf"^[ \t]*<?({SPEC})>?[ \t]*$", rf"^[ \t]*({PLAIN_NAME}|{QUOTED_NAME}|{uncaptured(WORDS)})[ \t]*<({SPEC})>[ \t]*$"
    alone = one.rlike(bare) & (one.contains("<") == one.contains(">"))

    def name(phrase: Column) -> Column:
        words = F.when(phrase.rlike(rf"^{uncaptured(WORDS)}$"), decoded_words(phrase))
        return F.when(phrase.startswith('"'), F.btrim(phrase, F.lit('"'))).when(phrase.contains("=?"), words).otherwise(F.regexp_replace(phrase, r"[ \t]+", " "))

    def shown(n: Column) -> Column:
        sound = (n != "") & ~n.rlike(r'^[ \t]|[ \t]$|[ \t]{2}|\t|["\\\x00-\x1f\x7f]|=\?')
        return F.when(sound, F.when(n.rlike(SPECIALS), F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n))

    full = F.concat(let(let(F.regexp_extract(one, named, 1), name), shown), F.lit(" <"), F.regexp_extract(one, named, 2), F.lit(">"))
    return F.when(alone, F.regexp_extract(one, bare, 1)).when(one.rlike(named), full)


def addresses(value: Column) -> Column:
    """A list of mailboxes in normal form; null if one of them isn't read here."""
    # no empty places between commas, and no quote that is left open
    parts = F.regexp_extract_all(value, F.lit(r'(?:"[^"]*"|[^",])+'), F.lit(0))
    shown = let(parts, lambda p: F.when(F.array_join(p, ",") == value, F.transform(p, mailbox)))
    all_of = let(shown, lambda s: F.when(~F.exists(s, lambda x: x.isNull()), F.array_join(s, ", ")))
    return F.when(F.btrim(value, F.lit(" \t")) == "", F.lit("")).otherwise(all_of)


def date(value: Column) -> Column:
    """A complete date with a numeric zone, with the weekday of that day; null for any other."""

    def shown(d: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), d["month"]).cast("string")
        weekday = let(F.try_to_date(F.concat_ws("-", d["year"], F.lpad(month, 2, "0"), d["day"])), lambda day: F.element_at(F.array(*map(F.lit, DAYS)), F.dayofweek(day)))
        return F.concat(weekday, F.lit(", "), d["day"], F.lit(" "), d["month"], F.lit(" "), d["year"], F.lit(" "), d["rest"])

    parts = F.struct(F.lpad(F.regexp_extract(value, DATE, 1), 2, "0").alias("day"), F.regexp_extract(value, DATE, 2).alias("month"), F.regexp_extract(value, DATE, 3).alias("year"), F.regexp_replace(value, DATE, "$4:$5:$6 $7").alias("rest"))
    return F.when(value.rlike(DATE), let(parts, lambda d: F.when(d["year"] >= "1000", shown(d))))


def read(name: Column, value: Column) -> Column:
    """The value of a header as the parser gives it; null where this reading isn't certain to be the same."""
    low = F.lower(name)
    ids = F.when(value.rlike(rf"^(?:<{SPEC}>)?$"), value)
    return F.when(one_of(low, OTHERS), F.lit(None).cast("string")).when(one_of(low, ADDRESSES), addresses(value)).when(low == "date", F.when(value == "", value).otherwise(date(value))).when(low == "message-id", ids).otherwise(text_value(value))


def outer_headers(content: Column, wanted: Column | None = None) -> Column:
    """struct(headers, certain) of a mail's own headers, read; values that aren't certain stay as written.

    certain: whether all values are those of the parser, but for headers of wanted = false, which get no say. wanted is a function of the
    name; by default MIME's own headers have none.
    """
    raw = unfolded(content)
    says = (lambda h: ~one_of(F.lower(h["k"]), OTHERS)) if wanted is None else (lambda h: wanted(h["k"]))
    both = F.transform(raw, lambda h: F.struct(h["k"].alias("k"), h["v"].alias("raw"), read(h["k"], h["v"]).alias("v")))

    def out(entries: Column) -> Column:
        shown = F.transform(entries, lambda h: F.struct(h["k"].alias("k"), F.coalesce(h["v"], h["raw"]).alias("v")))
        return F.struct(shown.alias("headers"), (~F.exists(entries, lambda h: h["v"].isNull() & says(h))).alias("certain"))

    return let(both, out)
