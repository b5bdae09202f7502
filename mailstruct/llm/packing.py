"""Hierarchical multi-length packing.

Documents are routed to context-size tiers (powers of two). The longest tier is packed first: each window opens with the
longest remaining document, its gap takes the longest shorter documents that fit, and what gap is left is closed with the
head of the shortest document that is longer, whose rest is routed anew. Shorter tiers follow in the same way with what is
left. So every window is full, and the at most one unfinished window of a partition ends as a ladder of ever shorter
power-of-two windows: no padding anywhere.

Each partition packs its own rows in blocks and carries less than one window from block to block, so memory is bounded by a
block, nothing is shuffled, and a lost executor costs its own partitions.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstruct.llm import tokens
from mailstruct.llm.common import release, table, text_of

TIERS = (256, 512, 1024, 2048)
END = 1
#: Tokens of a step group: as many for every tier, so steps cost the same.
STEP = 65_536
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long, doc_row long"


class Piece:
    """Tokens start to start + len(ids) of a document; ids is a view of the block's."""

    __slots__ = ("doc", "ids", "start")

    def __init__(self, doc: tuple, start: int, ids: np.ndarray):
        self.doc, self.start, self.ids = doc, start, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n]), Piece(self.doc, self.start + n, self.ids[n:])


class Packer:
    """Packs pieces of at most tiers[-1] tokens; windows come out as lists of pieces that fill a power of two."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.pool: dict[int, deque[Piece]] = defaultdict(deque)
        self.there = 0  # bit n: pool has pieces of n tokens

    def put(self, piece: Piece) -> None:
        n = len(piece.ids)
        self.pool[n].append(piece)
        self.there |= 1 << n

    def take(self, n: int) -> Piece:
        piece = self.pool[n].popleft()
        if not self.pool[n]:
            self.there &= ~(1 << n)
        return piece

    def add(self, doc: tuple, ids: np.ndarray) -> list[list[Piece]]:
        """Routes a document: full windows of the largest tier at once, its rest to the pool."""
        top, n = self.tiers[-1], len(ids)
        whole = [[Piece(doc, at, ids[at : at + top])] for at in range(0, n - top + 1, top)]
        if n % top:
            self.put(Piece(doc, n - n % top, ids[n - n % top :]))
        return whole

    def drain(self) -> Iterator[list[Piece]]:
        """Full windows, longest tier first; less than one window of pieces stays in the pool."""
        while self.there:
            longest = self.there.bit_length() - 1
            tier = next(t for t in self.tiers if t >= longest)
            window, gap = [self.take(longest)], tier - longest
            while gap and self.there:
                fits = self.there & ((1 << (gap + 1)) - 1)
                if fits:
                    n = fits.bit_length() - 1
                    window.append(self.take(n))
                    gap -= n
                else:
                    head, rest = self.take((self.there & -self.there).bit_length() - 1).cut(gap)
                    window.append(head)
                    self.put(rest)
                    gap = 0
            if gap:
                for piece in window:
                    self.put(piece)
                return
            yield window

    def finish(self) -> Iterator[list[Piece]]:
        """What drain left, as windows of the powers of two that add up to it."""
        left = deque(p for n in sorted(self.pool, reverse=True) for p in self.pool[n])
        self.pool.clear()
        self.there = 0
        total = sum(len(p.ids) for p in left)
        for bit in reversed(range(total.bit_length())):
            size, window = (total >> bit & 1) << bit, []
            while size:
                piece = left.popleft()
                if len(piece.ids) > size:
                    piece, rest = piece.cut(size)
                    left.appendleft(rest)
                window.append(piece)
                size -= len(piece.ids)
            if window:
                yield window


class Steps:
    """Balances step groups: windows of one tier fill a group of exactly STEP tokens; what each tier has over at the end shares groups, longest first."""

    def __init__(self, base: int, size: int = STEP):
        self.base, self.size, self.next = base, size, 0
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def add(self, window: list[Piece]) -> list[tuple[int, list[Piece]]]:
        tier = sum(len(p.ids) for p in window)
        group = self.open[tier]
        group.append(window)
        if len(group) * tier < self.size:
            return []
        self.open[tier] = []
        self.next += 1
        return [(self.base + self.next - 1, w) for w in group]

    def finish(self) -> list[tuple[int, list[Piece]]]:
        out, used = [], 0
        for tier in sorted(self.open, reverse=True):
            for window in self.open[tier]:
                if used + tier > self.size:
                    self.next, used = self.next + 1, 0
                out.append((self.base + self.next, window))
                used += tier
        self.open.clear()
        return out


def with_end(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids and then END."""
    ends = starts[1:] + np.arange(len(starts) - 1)
    out = np.empty(len(flat) + len(ends), "<u4")
    text = np.ones(len(out), bool)
    text[ends] = False
    out[ends], out[text] = END, flat
    return out, np.concatenate([[0], ends + 1])


def packer(tokenizer: str, tiers: tuple[int, ...], key: pa.DataType):
    names = ["doc_id", *(c.split()[0] for c in PIECES.split(", "))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encode, base = tokens.encoder(tokenizer), TaskContext.get().partitionId() << 33
        pool, steps, sequence, row = Packer(tiers), Steps(base), base, base

        def rows(numbered: list[tuple[int, list[Piece]]]) -> list[tuple]:
            nonlocal sequence
            out = []
            for step, window in numbered:
                tier, offset = sum(len(p.ids) for p in window), 0
                for p in window:
                    out.append((p.doc[0], p.start, len(p.ids), zlib.crc32(np.ascontiguousarray(p.ids)), p.doc[1], sequence, offset, tier, step, p.doc[2]))
                    offset += len(p.ids)
                sequence += 1
            return out

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], key), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        for batch in batches:
            flat, at = with_end(*encode.ids(batch.column("text")))
            done = []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for window in pool.add((doc_id, b - a, row), flat[a:b]):
                    done += steps.add(window)
                row += 1
            for window in pool.drain():
                done += steps.add(window)
            yield batch_of(rows(done))
            # what is carried must not keep this block's ids alive
            for pieces in pool.pool.values():
                for p in pieces:
                    p.ids = p.ids.copy()
            for group in steps.open.values():
                for window in group:
                    for p in window:
                        p.ids = p.ids.copy()
        done = [x for window in pool.finish() for x in steps.add(window)]
        yield batch_of(rows(done + steps.finish()))

    return pack


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row for each piece of a packed document of docs (doc_id, text).

    Null and empty texts are documents of the end token alone; each repeated row is packed as a document of its own
    (doc_row tells them apart); very long texts are cut into full windows; an empty table has no pieces; other columns of
    docs are not read.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers are ascending powers of two")
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(packer(tokenizer, tiers, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {PIECES}")


def op2_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
