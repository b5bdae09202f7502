"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames, frames into bundles; a skippable frame at a bundle's end holds the seek table
(compressed and plain size of each frame), in the public seekable format. An index maps each record to its bundle, frame, and
offset within the plain frame, so one record is read by decoding one frame. Equal payloads are stored once: the record
with the smallest id is a response, the others revisit it.

Only Spark's own writers reach every store, so the archive is a Parquet table with a row for each frame, uncompressed since
frames are: a reader that looks for a bundle and frame reads that row, not the bundle. The bytes of a bundle's rows in order,
closed by the seek table's, are the bundle; export_bundles writes them as files where executors mount a shared folder. Each
task bundles its own rows, a frame at a time. A page moves only if its payload may occur again, by a bitmap of fixed size.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailstruct.llm.common import Workspace, maybe_among, table, text_of

#: Plain bytes after which a frame ends, compressed bytes after which a bundle ends, and the compression level.
FRAME, BUNDLE, LEVEL = 256 << 10, 8 << 20, 3
#: Fixed values of the seekable format: skippable frame, footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, place: str) -> bytes:
    """A WARC/1.1 record; a revisit has no block, but states its payload's digest. Place tells records of one page apart."""
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    own = f"{'none' if page_id is None else page_id}:{digest}" + (f":{place}" if refers_to is not None or page_id is None else "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{own}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    block = payload if refers_to is None else b""
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, where the next record begins) of the record at an offset of a plain frame."""
    text = bytes(data[at : at + 4096])
    end = text.find(b"\r\n\r\n")
    if end < 0:
        text = bytes(data[at:])
        end = text.find(b"\r\n\r\n")
    lines = text[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = at + end + 4
    size = int(head["Content-Length"])
    return head, bytes(data[start : start + size]), start + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: (compressed, plain) size of each frame, then the footer."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: BinaryIO) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the bundle's end alone."""
    size = bundle.seek(0, 2)
    bundle.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", bundle.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    entry = 12 if flags & 0x80 else 8
    bundle.seek(size - 9 - entry * count)
    entries, at, out = bundle.read(entry * count), 0, []
    for k in range(count):
        small, plain = struct.unpack_from("<II", entries, entry * k)
        out.append((at, small, plain))
        at += small
    return out


def read_frame(bundle: BinaryIO, number: int) -> bytes:
    """One plain frame, without reading any other."""
    at, small, plain = read_seek_table(bundle)[number]
    bundle.seek(at)
    return plain_frame(bundle.read(small), plain)


def plain_frame(content: bytes, plain: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(content, max_output_size=plain)


class Bundler:
    """Gathers records into frames and frames into bundles; rows of FRAMES come out. The seek table is a bundle's last row."""

    def __init__(self, base: int, frame: int = FRAME, bundle: int = BUNDLE):
        import zstandard

        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.next, self.frame_size, self.bundle_size = base, frame, bundle
        self.frames, self.open, self.size, self.index = [], [], 0, []

    @property
    def place(self) -> str:
        """Names the next record."""
        return f"{self.next}.{len(self.frames)}.{len(self.index)}"

    def add(self, page_id: int | None, data: bytes) -> list[dict]:
        self.index.append({"page_id": page_id, "offset": self.size, "length": len(data)})
        self.open.append(data)
        self.size += len(data)
        out = self.close() if self.size >= self.frame_size else []
        return out + self.finish() if out and sum(small for small, _ in self.frames) >= self.bundle_size else out

    def close(self) -> list[dict]:
        if not self.open:
            return []
        small = self.press.compress(b"".join(self.open))
        out = {"bundle_id": self.next, "frame": len(self.frames), "plain_bytes": self.size, "content": small, "records": self.index}
        self.frames.append((len(small), self.size))
        self.open, self.size, self.index = [], 0, []
        return [out]

    def finish(self) -> list[dict]:
        out = self.close()
        if self.frames:
            out.append({"bundle_id": self.next, "frame": len(self.frames), "plain_bytes": None, "content": seek_table(self.frames), "records": []})
            self.next, self.frames = self.next + 1, []
        return out


FRAMES = "bundle_id long, frame int, plain_bytes long, content binary, records array<struct<page_id: long, offset: long, length: long>>"
ARROW_FRAMES = pa.schema([("bundle_id", pa.int64()), ("frame", pa.int32()), ("plain_bytes", pa.int64()), ("content", pa.binary()), ("records", pa.list_(pa.struct([("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])))])


def frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundler = Bundler(TaskContext.get().partitionId() << 33)
    for batch in batches:
        for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
            payload = html.encode()
            if full := bundler.add(page_id, record(page_id, url, payload, digest_of(payload), refers, bundler.place)):
                yield pa.RecordBatch.from_pylist(full, ARROW_FRAMES)
    if full := bundler.finish():
        yield pa.RecordBatch.from_pylist(full, ARROW_FRAMES)


def write_bundles(pages: DataFrame, work: Workspace, least: int = 0) -> DataFrame:
    """The frames of bundles that hold all pages (page_id, url, html), written and read again.

    Payloads of at least so many bytes are stored once. Null html is an empty payload and a null url an empty one; very long
    payloads are frames of their own. Of repeated rows one can be a response, the others revisit it. Rows without page_id
    revisit an equal payload of a page with an id, and are stored in full if there is none, since nothing could refer to
    them. An empty table gives no bundles; other columns are not read.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), text_of("html").alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    long = F.octet_length("html") >= least
    keys = work.write(pages.where(long).select("page_id", "digest"), "keys")
    # only payloads that occur again; the group with a third of all rows is reduced before the shuffle
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows")).where((F.col("rows") > 1) & F.col("first_id").isNotNull())
    firsts = work.write(firsts.drop("rows"), "firsts")
    marked = maybe_among(F.col("digest"), firsts)(pages)
    once = marked.where(~F.col("maybe") | ~long).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    again = marked.where(F.col("maybe") & long).drop("maybe").join(firsts.hint("merge"), "digest", "left")
    response = F.col("first_id").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    if keys.groupBy("page_id", "digest").count().where("count > 1").limit(1).count():
        # of rows that agree in page_id and payload the first is the response
        place = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
        response = F.col("first_id").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")) & (place == 1))
    again = again.withColumn("response", response).select("page_id", "url", "html", F.when(~F.col("response"), F.col("first_id")).alias("refers_to"))
    return work.write(once.unionAll(again).mapInArrow(frame_rows, FRAMES), "frames", compression="uncompressed")


def index_of(frames: DataFrame) -> DataFrame:
    """page_id, bundle_id, frame, offset and length of every record."""
    return frames.select("bundle_id", "frame", F.explode("records").alias("r")).select("r.page_id", "bundle_id", "frame", "r.offset", "r.length")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle_id long, frame int, offset long"


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every record of every frame, found through the index; a response's size and digest are those of the bytes read."""
    page_of = lambda uri: None if (own := uri.removeprefix("<urn:page:").rstrip(">").split(":")[0]) == "none" else int(own)
    for batch in batches:
        rows = []
        for bundle_id, frame, plain_bytes, content, records in zip(*(batch.column(c).to_pylist() for c in ("bundle_id", "frame", "plain_bytes", "content", "records")), strict=True):
            plain = memoryview(plain_frame(content, plain_bytes) if records else b"")
            for r in records:
                head, block, after = parse_record(plain, r["offset"])
                if page_of(head["WARC-Record-ID"]) != r["page_id"] or after - r["offset"] != r["length"]:
                    raise ValueError(f"bundle {bundle_id} does not hold record {r['page_id']} where its index says")
                stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
                if refers is None and digest_of(block) != stated:
                    raise ValueError(f"record {r['page_id']} is damaged")
                rows.append((r["page_id"], len(block) if refers is None else None, stated, head["WARC-Type"], refers, bundle_id, frame, r["offset"]))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], [c.split()[0] for c in READ.split(", ")])


def read_bundles(frames: DataFrame, work: Workspace) -> DataFrame:
    """One row for each record of bundles; a revisit's size is that of the response that it refers to, which must be there."""
    read = work.write(frames.mapInArrow(read_rows, READ), "read")
    # a page can be the response of several payloads, of each once
    held = read.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("size"))
    revisits = read.where("record_type = 'revisit'").join(held.hint("merge"), ["refers_to", "payload_digest"], "left")
    missing = F.raise_error(F.concat(F.lit("nothing holds what a revisit refers to: "), F.col("refers_to").cast("string"))).cast("long")
    revisits = revisits.withColumn("payload_bytes", F.when(F.col("size").isNull(), missing).otherwise(F.col("size")))
    return read.where("record_type = 'response'").unionAll(revisits.select(*read.columns))


def export_bundles(frames: DataFrame, folder: str) -> None:
    """Writes each bundle as <bundle_id>.warc.zst into a folder that every executor mounts. A retried task writes the same file."""

    def write(rows: Iterator) -> None:
        import os
        import pathlib

        target = None
        for row in rows:
            path = pathlib.Path(folder) / f"{row.bundle_id}.warc.zst"
            part = path.with_suffix(f".{TaskContext.get().taskAttemptId()}")
            target = target or part.open("wb")
            target.write(row.content)
            if row.plain_bytes is None:
                target.close()
                target = None
                os.replace(part, path)

    frames.repartition("bundle_id").sortWithinPartitions("bundle_id", "frame").select("bundle_id", "plain_bytes", "content").foreachPartition(write)


def op7_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark)
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"), work), work).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32: five hexadecimal digits are 20 bits, which are four base32 characters.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS hex FROM pages
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, hex, min(page_id) OVER (PARTITION BY hex) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
