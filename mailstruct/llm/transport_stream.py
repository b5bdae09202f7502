"""MPEG transport streams as a column.

``store`` wraps a payload as access units of a private elementary stream: program association and program map tables, then
packetized elementary packets with time stamps; the first transport packet of each access unit is a random-access point with a
clock reference. ``parse`` reads any stream: it finds packet alignment, follows the program tables (checking their CRC), checks
continuity counters, reassembles elementary packets and lists time stamps with their random-access points. Both work on
whole arrays of 188-byte packets.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstruct.llm.common import table, text_of

PACKET, SYNC, PMT_PID, STREAM_PID, PROGRAM, PRIVATE, STREAM_ID = 188, 0x47, 0x1000, 0x100, 1, 0x06, 0xBD
#: Payload bytes of an access unit, and its duration in 90 kHz ticks.
UNIT, TICKS = 32_768, 3600


def crc_table() -> np.ndarray:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return np.array(out, np.uint64)


CRC = crc_table().tolist()


def section_crc(data: bytes) -> int:
    """The CRC of program tables; 0 over a section that ends with its own."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
    return c


def section(kind: int, number: int, body: bytes) -> bytes:
    """A table section with its CRC."""
    length = len(body) + 9
    head = bytes([kind, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def table_packet(pid: int, counter: int, data: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter, 0]) + data).ljust(PACKET, b"\xff")


#: The program tables at the head of every stored stream.
TABLES = table_packet(0, 0, section(0, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + table_packet(
    PMT_PID, 0, section(2, PROGRAM, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0, PRIVATE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 255, 0xF0, 0]))
)


def stamp(t: int) -> bytes:
    """A 33-bit presentation time in five bytes with marker bits."""
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, 0x01 | t >> 14 & 0xFE, t >> 7 & 255, 0x01 | t << 1 & 0xFE])


def store(payload: bytes) -> bytes:
    """A transport stream that carries the payload without loss."""
    out, counter = [TABLES], 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        time = unit * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(time) + data
        # the first packet has 8 bytes of adaptation field: random access and clock reference
        first = b"\x07\x50" + bytes([time >> 25 & 255, time >> 17 & 255, time >> 9 & 255, time >> 1 & 255, (time & 1) << 7 | 0x7E, 0])
        room = PACKET - 4
        middle = max(0, (len(pes) - (room - 8)) // room)
        packets = np.empty((1 + middle, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(1 + middle)) & 15
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        head = pes[: room - 8]
        if len(head) < room - 8:  # all in one packet: the adaptation field grows by stuffing
            short = room - 8 - len(head)
            packets[0, 4:] = np.frombuffer(bytes([7 + short]) + first[1:] + b"\xff" * short + head, np.uint8)
        else:
            packets[0, 4:] = np.frombuffer(first + head, np.uint8)
            if middle:
                packets[1:, 4:] = np.frombuffer(pes, np.uint8, middle * room, room - 8).reshape(middle, room)
        out.append(packets.tobytes())
        counter += 1 + middle
        rest = pes[room - 8 + middle * room :]
        if rest:
            stuffing = room - 1 - len(rest)
            field_ = bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            out.append(bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter & 15]) + field_ + rest)
            counter += 1
    return b"".join(out)


@dataclass
class Stream:
    """What ``parse`` found. units: (stream's pid, presentation time or None, packet number, random access, payload)."""

    packets: int = 0
    skipped_bytes: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    table_errors: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    transport_errors: int = 0
    scrambled: int = 0
    units: list[tuple[int, int | None, int, bool, bytes]] = field(default_factory=list)

    def payload(self) -> bytes:
        return b"".join(u[4] for u in self.units)

    def feature(self) -> str:
        """Counts, time stamps and random-access points, as JSON with sorted keys."""
        kinds = {str(pid): kind for pid, kind in self.streams.items()}
        points = [[u[2], u[1]] for u in self.units if u[3]]
        times = [u[1] for u in self.units if u[1] is not None]
        return json.dumps({"packets": self.packets, "programs": {str(k): v for k, v in self.programs.items()}, "streams": kinds, "units": len(self.units), "first_time": min(times, default=None), "last_time": max(times, default=None), "random_access": points, "continuity_errors": self.continuity_errors, "duplicates": self.duplicates, "table_errors": self.table_errors, "transport_errors": self.transport_errors, "scrambled": self.scrambled, "skipped_bytes": self.skipped_bytes}, sort_keys=True, separators=(",", ":"))


def aligned(media: bytes) -> tuple[np.ndarray, int]:
    """Packets of 188 bytes that begin with the sync byte, and how many bytes lie between them."""
    data = np.frombuffer(media, np.uint8)
    whole = len(data) // PACKET
    packets = data[: whole * PACKET].reshape(whole, PACKET)
    if whole and (packets[:, 0] == SYNC).all():
        return packets, len(data) - whole * PACKET
    starts, at = [], 0
    syncs = np.flatnonzero(data == SYNC)
    while at + PACKET <= len(data):
        k = np.searchsorted(syncs, at)
        if k == len(syncs) or syncs[k] + PACKET > len(data):
            break
        at = int(syncs[k])
        after = at + PACKET
        if after >= len(data) or data[after] == SYNC:
            starts.append(at)
            at = after
        else:
            at += 1
    found = np.array(starts, np.int64)
    return data[found[:, None] + np.arange(PACKET)] if len(found) else np.empty((0, PACKET), np.uint8), len(data) - PACKET * len(found)


def sections(packets: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """Whole table sections of one packet id's packets."""
    held = b""
    for p, o, s in zip(packets, offsets, starts, strict=True):
        data = p[o:].tobytes()
        if s and data:
            pointer = data[0]
            held += data[1 : 1 + pointer]
            yield from complete(held)[0]
            held = data[1 + pointer :]
        elif held:
            held += data
        found, held = complete(held)
        yield from found


def complete(data: bytes) -> tuple[list[bytes], bytes]:
    out = []
    while len(data) >= 3 and data[0] != 0xFF:
        size = 3 + ((data[1] & 15) << 8 | data[2])
        if len(data) < size:
            return out, data
        out.append(data[:size])
        data = data[size:]
    return out, data if data[:1] != b"\xff" else b""


def parse(media: bytes) -> Stream:
    """Reads a transport stream. Damage never raises: it is counted, and the rest is read."""
    packets, skipped = aligned(media)
    out = Stream(packets=len(packets), skipped_bytes=skipped)
    if not len(packets):
        return out
    b1, b3, b4 = packets[:, 1], packets[:, 3], packets[:, 4].astype(np.int64)
    pid = (b1.astype(np.int64) & 31) << 8 | packets[:, 2]
    start, broken, scrambled = (b1 & 0x40) > 0, (b1 & 0x80) > 0, (b3 & 0xC0) > 0
    control, counter = b3 >> 4 & 3, b3 & 15
    adapted = (control & 2) > 0
    offset = np.where(adapted, 5 + b4, 4)
    loaded = ((control & 1) > 0) & (offset < PACKET) & ~broken & ~scrambled
    flags = np.where(adapted & (b4 > 0), packets[:, 5], 0)
    random, jump = (flags & 0x40) > 0, (flags & 0x80) > 0
    out.transport_errors, out.scrambled = int(broken.sum()), int((scrambled & ~broken).sum())

    def tables(of: int, kind: int) -> Iterator[bytes]:
        some = np.flatnonzero((pid == of) & loaded)
        for s in sections(packets[some], offset[some], start[some]):
            if s[0] == kind:
                if len(s) < 12 or section_crc(s):
                    out.table_errors += 1
                else:
                    yield s

    for s in tables(0, 0):
        for at in range(8, len(s) - 4, 4):
            number = s[at] << 8 | s[at + 1]
            if number:
                out.programs[number] = (s[at + 2] & 31) << 8 | s[at + 3]
    for of in dict.fromkeys(out.programs.values()):
        for s in tables(of, 2):
            at = 12 + ((s[10] & 15) << 8 | s[11])
            while at + 5 <= len(s) - 4:
                out.streams[(s[at + 1] & 31) << 8 | s[at + 2]] = s[at]
                at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
    for of in [*dict.fromkeys([0, *out.programs.values()]), *out.streams]:
        some = np.flatnonzero((pid == of) & ((control & 1) > 0) & ~broken)
        step = np.diff(counter[some].astype(np.int64)) & 15
        again = np.concatenate([[False], (step == 0) & ~jump[some[1:]]]) if len(some) else np.zeros(0, bool)
        out.duplicates += int(again.sum())
        out.continuity_errors += int(((step > 1) & ~jump[some[1:]]).sum())
        if of in out.streams:
            elementary(out, of, packets, some[~again & loaded[some]], offset, start, random)
    out.units.sort(key=lambda u: u[2])
    return out


def elementary(out: Stream, pid: int, packets: np.ndarray, some: np.ndarray, offset: np.ndarray, start: np.ndarray, random: np.ndarray) -> None:
    """Reassembles the elementary packets of one stream from its transport packets."""
    heads = np.flatnonzero(start[some])
    if not len(heads):
        return
    own, sizes = packets[some], PACKET - offset[some]
    data = own[np.arange(PACKET) >= offset[some][:, None]].tobytes()
    first = np.concatenate([[0], np.cumsum(sizes)])
    for head, after in zip(heads, [*heads[1:], len(some)], strict=True):
        pes = data[first[head] : first[after]]
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            out.table_errors += 1
            continue
        length, time, body = pes[4] << 8 | pes[5], None, 9 + pes[8]
        if pes[7] & 0x80 and pes[8] >= 5 and len(pes) >= 14:
            t = pes[9:14]
            time = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        out.units.append((pid, time, int(some[head]), bool(random[some[head]]), pes[body : 6 + length if length else None]))


def padded(text: bytes, multiple: int = 64) -> bytes:
    """text and zero bytes up to a positive multiple."""
    return text.ljust(max(multiple, -(-len(text) // multiple) * multiple), b"\x00")


def media_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("payload")
        media = [store(x) for x in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(media, pa.large_binary()) if i == at else c for i, c in enumerate(batch.columns)], ["media" if i == at else n for i, n in enumerate(batch.schema.names)])


FEATURE_NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "n_units", "random_access"]
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_units long, random_access array<struct<packet: long, time: long>>"


def feature_rows(names: list[str]):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("packet", pa.int64()), ("time", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media").to_pylist():
                found = parse(media)
                payload = found.payload()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), found.feature(), found.packets, len(found.units), [{"packet": u[2], "time": u[1]} for u in found.units if u[3]]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*names, *FEATURE_NAMES])

    return run


def store_column(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with its binary column payload replaced by media, a transport stream that carries it; a column of that name goes. No nulls."""
    others = [c for c in df.columns if c not in (payload, "media")]
    df = df.select(*others, F.col(payload).alias("payload"))
    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.mapInArrow(media_rows, f"{shape}, media binary")


def read_column(df: DataFrame) -> DataFrame:
    """df with its transport streams (media, no nulls) read back: FEATURES in place of media and of columns of their names."""
    others = [c for c in df.columns if c != "media" and c not in FEATURE_NAMES]
    df = df.select(*(F.col(f"`{c}`") for c in others), "media")
    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.mapInArrow(feature_rows(others), f"{shape}, {FEATURES}")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are stored as 64 zero bytes; equal texts give equal streams; no text is too long."""
    docs = table(spark, sf_dir, "documents")
    pad = F.expr("cast(greatest(64, ceil(octet_length(text) / 64) * 64) as int)")
    docs = docs.select("doc_id", text_of().alias("text"))
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.rpad(F.encode("text", "UTF-8"), pad, F.lit(b"\x00")).alias("payload"))
    return read_column(store_column(rows))
