"""The one place where a message's bytes become rows: a depth-first walk over the standard library's message tree.

``email_parts`` gives a row for every part that a layer's walk meets, so everything after it is relational. A layer is a
message: the mail itself, each message embedded in it, and each message attached as a file. Layers are numbered in the
order in which they are kept; a layer whose identity (message id, else signature) came before is left out, and a file that
holds a known message is left out with all that it holds. Each part is read once at its true depth, so the walk is linear.
"""

from __future__ import annotations

import base64
import email.headerregistry
import email.policy
import hashlib
import re
from collections.abc import Iterator
from email.message import EmailMessage, Message
from email.parser import BytesParser
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = (
    "email_id long, error string, layer_seq int, layer_depth int, parent_layer_seq int, via_attachment string, via_mime_type string, signature string, "
    "headers array<struct<k: string, v: string>>, part_seq int, content_type string, filename string, content_id string, is_attachment boolean, own boolean, "
    "multipart boolean, att_idx int, image_idx int, has_markup boolean, text string, payload binary"
)
HEADER = pa.struct([("k", pa.string()), ("v", pa.string())])
ARROW = pa.schema(
    [
        ("email_id", pa.int64()), ("error", pa.string()), ("layer_seq", pa.int32()), ("layer_depth", pa.int32()), ("parent_layer_seq", pa.int32()),
        ("via_attachment", pa.string()), ("via_mime_type", pa.string()), ("signature", pa.string()), ("headers", pa.list_(HEADER)), ("part_seq", pa.int32()),
        ("content_type", pa.string()), ("filename", pa.string()), ("content_id", pa.string()), ("is_attachment", pa.bool_()), ("own", pa.bool_()),
        ("multipart", pa.bool_()), ("att_idx", pa.int32()), ("image_idx", pa.int32()), ("has_markup", pa.bool_()), ("text", pa.string()), ("payload", pa.binary()),
    ]
)
LONG_BASE64 = re.compile(rb"[A-Za-z0-9+/=\r\n]{800,}")
#: Printable ASCII without encoded words reads as it is written.
PLAIN = re.compile(r"[\t -~]*\Z")
LINE_ENDS = re.compile(r"[\r\n]+")
#: Header values that a worker remembers, up to so many characters each: types and dispositions repeat endlessly.
REMEMBER, SHORT = 4096, 300


@lru_cache(REMEMBER)
def parsed_header(name: str, value: str) -> str:
    return email.policy.default.header_factory(name, value)


#: Stands for what a message doesn't have.
MISSING = object()


class ReadMessage(EmailMessage):
    """A message that is read and not changed once its headers are there: headers, types, parameters and texts are found once."""

    def __init__(self, policy=None):
        super().__init__(policy)
        self.known: dict = {}

    def set_raw(self, name, value) -> None:
        self.known.clear()
        super().set_raw(name, value)

    def __setitem__(self, name, value) -> None:
        self.known.clear()
        super().__setitem__(name, value)

    def __delitem__(self, name) -> None:
        self.known.clear()
        super().__delitem__(name)

    def set_default_type(self, ctype) -> None:
        self.known.clear()
        super().set_default_type(ctype)

    def get(self, name, failobj=None):
        key = "header", name
        value = self.known.get(key)
        if value is None:
            value = self.known[key] = super().get(name, MISSING)
        return failobj if value is MISSING else value

    def get_content_type(self) -> str:
        value = self.known.get("type")
        if value is None:
            value = self.known["type"] = super().get_content_type()
        return value

    def get_content(self, *args, **kw):
        if args or kw:
            return super().get_content(*args, **kw)
        value = self.known.get("content")
        if value is None:
            value = super().get_content()
            if isinstance(value, str):
                self.known["content"] = value
        return value

    def _get_params_preserve(self, failobj, header):
        key = "parameters", header
        value = self.known.get(key)
        if value is None:
            value = self.known[key] = super()._get_params_preserve(MISSING, header)
        return failobj if value is MISSING else value


class ReadPolicy(email.policy.EmailPolicy):
    """The default policy, with less work for what reading a header gives: a plain unstructured value is itself, and short
    values are parsed once."""

    def header_fetch_parse(self, name: str, value: str) -> str:
        if hasattr(value, "name"):
            return value
        free = name.lower() not in STRUCTURED and "=?" not in value
        if free and PLAIN.match(value):
            return value
        value = LINE_ENDS.sub("", value)
        if free and "=?" not in value and PLAIN.match(value):
            return value
        return parsed_header(name, value) if len(value) <= SHORT else email.policy.default.header_factory(name, value)


#: Headers that are more to the standard library than text.
STRUCTURED = frozenset(n for n, kind in email.policy.default.header_factory.registry.items() if not issubclass(kind, email.headerregistry.UnstructuredHeader) or issubclass(kind, email.headerregistry.DateHeader))
POLICY = ReadPolicy(message_factory=ReadMessage)


#: Compressed input for one parsing task, and sizes from which on Spark doesn't know a size.
TASK_BYTES, UNKNOWN = 32 << 20, 1 << 62


class DepthError(ValueError):
    """A layer lies deeper than allowed; the whole mail fails."""


def read_message(content: bytes) -> Message | None:
    try:
        return BytesParser(policy=POLICY).parsebytes(content)
    except Exception:  # noqa: BLE001  any input may come
        return None


def repaired(payload: object) -> Message | None:
    """The message in an embedded payload: as it is, from bytes, after a second base64 layer, or with indented headers moved left."""
    if isinstance(payload, Message):
        return payload
    if isinstance(payload, list):
        return payload[0] if payload and isinstance(payload[0], Message) else None
    if not isinstance(payload, bytes | bytearray):
        return None
    data = bytes(payload)
    first = read_message(data)
    if first is not None and first.keys():
        return first
    if LONG_BASE64.fullmatch(data):
        data = base64.b64decode(data)
        inner = read_message(data)
        if inner is not None and inner.keys():
            return inner
    gap = re.search(rb"\r?\n\r?\n", data)
    if gap is None:
        return first
    left = b"\n".join(line.lstrip(b" \t") if line.strip() else line for line in data[: gap.start()].split(b"\n"))
    moved = read_message(left + b"\r\n\r\n" + data[gap.end() :])
    return moved if moved is not None and moved.keys() else first


def header(msg: Message, name: str) -> str:
    try:
        return str(msg.get(name, "") or "")
    except Exception:  # noqa: BLE001  a header that the policy can't read
        return ""


def all_headers(msg: Message) -> list[dict]:
    values = []
    for name, raw in msg.raw_items():
        try:
            value = str(msg.policy.header_fetch_parse(name, raw))
        except Exception:  # noqa: BLE001
            value = ""
        values.append({"k": scalar(name), "v": scalar(value)})
    return values


def scalar(text: str) -> str:
    """Text that Arrow takes: lone surrogates, which stand for undecodable bytes, become replacement characters."""
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if text.isascii() is False else text


def content_of(part: Message) -> str | None:
    """A part's decoded text without NULs; empty if it can't be decoded, null if it isn't text."""
    try:
        content = part.get_content()
    except Exception:  # noqa: BLE001
        return ""
    return content.replace("\x00", "") if isinstance(content, str) else None


def sample_of(msg: Message) -> str:
    """The first 500 characters of the first text part that has any."""
    if not msg.is_multipart():
        try:
            content = msg.get_content()
        except Exception:  # noqa: BLE001
            return ""
        return str(content[:500]) if content else ""
    for part in msg.walk():
        if part.get_content_type() == "text/plain":
            try:
                content = part.get_content()
            except Exception:  # noqa: BLE001
                continue
            if content:
                return content[:500]
    return ""


def identity(msg: Message) -> tuple[str, str]:
    """(message id or signature, signature)."""
    if not isinstance(msg, ReadMessage):
        return identity_of(msg)
    if "identity" not in msg.known:
        msg.known["identity"] = identity_of(msg)
    return msg.known["identity"]


def identity_of(msg: Message) -> tuple[str, str]:
    fields = [header(msg, n).strip() for n in ("subject", "from", "date", "message-id")]
    mark = hashlib.sha256("|".join([*fields, sample_of(msg)]).encode("utf-8", "surrogatepass")).hexdigest()[:16]
    return fields[3] or mark, mark


def layers_of(msg: Message, depth: int = 0) -> Iterator[tuple[int, Message]]:
    """The message and those embedded in it, depth first, each once at its depth."""
    yield depth, msg
    yield from embedded(msg, depth)


def embedded(msg: Message, depth: int) -> Iterator[tuple[int, Message]]:
    parts = [msg]
    while parts:
        part = parts.pop()
        if part.get_content_type() == "message/rfc822":
            payload = part.get_payload()
            inner = repaired(payload if payload else part.get_payload(decode=True))
            if inner is not None:
                yield from layers_of(inner, depth + 1)
        elif part.is_multipart():
            parts.extend(reversed([p for p in part.get_payload() if isinstance(p, Message)]))


def attachments_of(msg: Message) -> list[Message]:
    try:
        return list(msg.iter_attachments())
    except Exception:  # noqa: BLE001  single parts and broken structures have none
        return []


class MarkupFinder(HTMLParser):
    found = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.found = True

    handle_startendtag = handle_starttag


def has_markup(text: str) -> bool:
    if "<" not in text or not re.search(r"<[^>]+>", text):
        return False
    finder = MarkupFinder()
    try:
        finder.feed(text)
        finder.close()
    except Exception:  # noqa: BLE001
        return False
    return finder.found


def own_parts(msg: Message) -> set[int]:
    """Parts of the layer itself, not of messages embedded in it."""
    out, parts = set(), [msg]
    while parts:
        part = parts.pop()
        out.add(id(part))
        if part.get_content_type() != "message/rfc822" and part.is_multipart():
            parts.extend(p for p in part.get_payload() if isinstance(p, Message))
    return out


def name_of(part: Message) -> str:
    try:
        return scalar((part.get_filename() or "").rstrip("\x00").strip())
    except Exception:  # noqa: BLE001
        return ""


def part_rows(layer: dict, msg: Message) -> list[dict]:
    attached = {id(p): p for p in attachments_of(msg)}
    own, rows, att_idx, image_idx = own_parts(msg), [], 1, 1
    for seq, part in enumerate(msg.walk()):
        kind = part.get_content_type().rstrip("\x00").strip()
        row = layer | {"part_seq": seq, "content_type": kind, "filename": name_of(part) or None, "is_attachment": id(part) in attached, "own": id(part) in own, "multipart": msg.is_multipart(), "has_markup": False}
        row["headers"] = all_headers(msg) if seq == 0 else None
        payload = None
        if row["is_attachment"] or kind.startswith("image/"):
            try:
                payload = part.get_payload(decode=True)
            except Exception:  # noqa: BLE001
                att_idx += row["is_attachment"]
        if row["is_attachment"]:
            row["is_attachment"] = bool(payload)
            if payload:
                row["att_idx"], row["payload"] = att_idx, payload
                att_idx += 1
        if kind.startswith("image/"):
            row["image_idx"], row["payload"] = image_idx, payload or b""
            row["content_id"] = scalar(header(part, "Content-ID").rstrip("\x00").strip()) or None
            image_idx += 1
        if kind in ("text/plain", "text/html"):
            text = content_of(part)
            row["text"] = None if text is None else scalar(text)
            row["has_markup"] = bool(text) and kind == "text/plain" and has_markup(text)
        rows.append(row)
    return rows


def email_rows(email_id: int | None, content: bytes | None, max_depth: int = 10, recursive: bool = False) -> list[dict]:
    """All rows of one mail; a mail that fails has a single row with its error."""
    msg = read_message(content or b"")
    if msg is None:
        return [{"email_id": email_id, "error": "EmailParsingError: the message can't be read"}]
    kept: list[tuple[dict, Message]] = []
    seen: set[str] = set()

    def keep(m: Message, depth: int, parent: int | None, via: str | None, kind: str | None) -> None:
        key, mark = identity(m)
        if key not in seen:
            seen.add(key)
            kept.append(({"email_id": email_id, "layer_seq": len(kept), "layer_depth": depth, "parent_layer_seq": parent, "via_attachment": via, "via_mime_type": kind, "signature": mark}, m))

    try:
        for depth, m in layers_of(msg):
            if depth > max_depth:
                raise DepthError(f"Nesting depth {depth} exceeds limit {max_depth}")
            keep(m, depth, None, None, None)
        at, rows = 0, []
        main = len(kept)
        while at < len(kept):
            layer, m = kept[at]
            rows.append(part_rows(layer, m))
            if at < main or recursive:
                expand(rows[-1], layer, keep, seen, max_depth if recursive else None)
            at += 1
    except DepthError as e:
        return [{"email_id": email_id, "error": f"SecurityViolationError: {e}"}]
    except Exception as e:  # noqa: BLE001  one mail must not end the job
        return [{"email_id": email_id, "error": f"EmailParsingError: {e}"}]
    return [r for layer_rows in rows for r in layer_rows]


def expand(rows: list[dict], layer: dict, keep, seen: set[str], max_depth: int | None) -> None:
    """Layers from the files with mail that a layer has attached, but for embedded messages, which are layers already."""
    for row in rows:
        name = row.get("filename") or f"attachment_{row.get('att_idx')}"
        if not row["is_attachment"] or not name.lower().endswith(".eml") or row["content_type"] == "message/rfc822":
            continue
        inner = read_message(row["payload"])
        if inner is None or identity(inner)[0] in seen:
            continue
        for depth, m in layers_of(inner):
            true_depth = layer["layer_depth"] + 1 + depth
            if max_depth is not None and true_depth > max_depth:
                raise DepthError(f"Nesting depth {true_depth} exceeds limit {max_depth}")
            keep(m, true_depth, layer["layer_seq"], name, row["content_type"])


def parser(max_depth: int, recursive: bool, with_payload: bool, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for email_id, content in zip(batch.column("email_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if content is not None and len(content) > max_bytes:
                    rows.append({"email_id": email_id, "error": f"SecurityViolationError: File size {len(content)} exceeds limit {max_bytes}"})
                    continue
                for r in email_rows(email_id, content, max_depth, recursive):
                    if not with_payload:
                        r["payload"] = None
                    size += len(r.get("payload") or b"") + len(r.get("text") or "")
                    rows.append(r)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return run


def input_bytes(rows: DataFrame) -> int:
    """Bytes of the files that rows are read from, as far as Spark knows them."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()  # noqa: SLF001
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(n for n in sizes if n < UNKNOWN)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly over tasks: what reads them is bound by processors, and files may be few and uneven.

    At least as many tasks as the rows had before where that is known, as the cluster runs at once, and as TASK_BYTES of input ask for.
    """
    spark = rows.sparkSession
    if rows.isStreaming:
        return rows
    given = rows._jdf.queryExecution().sparkPlan().outputPartitioning().numPartitions()  # noqa: SLF001
    by_size = -(-input_bytes(rows) // TASK_BYTES)
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), given, by_size), *keys)


def email_parts(mails: DataFrame, max_depth: int = 10, recursive_eml: bool = False, with_payload: bool = True, max_file_size_mb: int = 50) -> DataFrame:
    """Part rows of mails (email_id long, content binary); see PARTS. Mails that fail have one row with an error."""
    mails = spread(mails.select(F.col("email_id").cast("long"), F.col("content")), "email_id", "content")
    return mails.mapInArrow(parser(max_depth, recursive_eml, with_payload, max_file_size_mb << 20), PARTS)
