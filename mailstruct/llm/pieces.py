"""Exact encoding with merge-type piece vocabularies, by backtracking instead of merging.

Merging joins the best pair of neighbours (highest score, then leftmost) until none is in the vocabulary. A sequence of
pieces is its result exactly if every two neighbours are the result for their own two strings, since the first merge across any cut
would be the best one of those two alone as well. So an automaton (Aho-Corasick) finds the pieces that begin at each position, the longest
that goes with the piece before is taken, and where none does the last piece is given back for a shorter one. The string up to
a position has one result only, so a position that failed once has failed for good: a bit each marks them, and time is linear.
Whether two pieces go together is found by merging them again side by side: each keeps the order in which it was merged itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstruct.llm.common import table, text_of, worker_cache
from mailstruct.llm.tokens import tokenizer_path

TOKENIZER = "piece_bpe_32k.model"
SPACE = "▁"
#: Chunks and pairs that a process remembers, in two halves; longer chunks are not remembered; positions whose matches are held at once.
CHUNKS, PAIRS, CHUNK, WINDOW = 400_000, 200_000, 64, 4096


class Memory(dict):
    """What a function gave for its last keys. trim() makes the newer half the older one once it is full, and that one goes."""

    def __init__(self, function, half: int):
        self.function, self.half, self.old = function, half, {}

    def __missing__(self, key):
        out = self.old.get(key)
        self[key] = out = self.function(key) if out is None else out
        return out

    def trim(self) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()


def chunk_pattern(pieces: Iterable[str]) -> str:
    """What cuts a text into chunks that are encoded alone, since no merge reaches across two characters that no piece holds side by side.

    A cut before spaces, and between letters and all else but the spaces before them. Letters that a piece holds beside others are
    taken for others.
    """
    pieces = list(pieces)
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        return r"[\s\S]+"
    mixed = r"([^\W\d_])[\W\d_]|[\W\d_]([^\W\d_])"
    odd = "".join(sorted({re.escape(a or b) for p in pieces for a, b in re.findall(mixed, p.lstrip(SPACE))}))
    letter, other = rf"[^\W\d_{odd}]", rf"(?:[^\w{SPACE}]+|[\d_{odd}]+)"
    if any(re.search(f"{letter}{other}|{other}{letter}", p) for p in pieces):
        return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
    return f"{SPACE}*(?:{letter}+|{other}+)|{SPACE}+"


class Pieces:
    """A vocabulary of pieces with scores, byte pieces for all other characters, and the library's own decoder."""

    def __init__(self, name: str = TOKENIZER):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        data = Path(tokenizer_path(name)).read_bytes()
        spec = proto.ModelProto()
        spec.ParseFromString(data)
        kinds, rule = proto.ModelProto.SentencePiece, spec.normalizer_spec
        # what this code knows exactly; it takes no other file
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{name} is no merge vocabulary with byte pieces")
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not rule.escape_whitespaces or spec.denormalizer_spec.precompiled_charsmap:
            raise ValueError(f"{name} changes its texts")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError(f"{name} has pieces that are not merged")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        normal = [(i, p) for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL]
        self.ids = {p.piece: i for i, p in normal}
        self.scores = {p.piece: p.score for _, p in normal}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.longest = max(map(len, self.ids))
        self.histories = {piece: steps for piece in self.ids if (steps := self.history(piece))}
        self.automaton = ahocorasick.Automaton()
        for piece in self.histories:  # no others can come out of merging
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.chunk = re.compile(chunk_pattern(self.ids))
        self.goes = Memory(self.go_together, PAIRS // 2)
        self.known = Memory(self.encode_chunk, CHUNKS // 2)

    def history(self, piece: str) -> tuple:
        """(score, first part, last part) after each merge of the piece's own characters, from (inf, first, last) on; () if they
        don't become the piece."""
        parts, steps = list(piece), [(math.inf, piece[0], piece[-1])]
        while len(parts) > 1:
            scores = [self.scores.get(a + b, -math.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -math.inf:
                return ()
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return tuple(steps)

    def go_together(self, two: tuple[str, str]) -> bool:
        """Whether merging both strings' characters gives just these two. Their histories run side by side, the better score first
        and the left one among equals, until a pair across the cut would come before either."""
        left, right = (self.histories.get(x) or self.history(x) for x in two)
        i = j = 0
        while True:
            next_left = left[i + 1][0] if i + 1 < len(left) else -math.inf
            next_right = right[j + 1][0] if j + 1 < len(right) else -math.inf
            across = self.scores.get(left[i][2] + right[j][1])
            if across is not None and across > next_left and across >= next_right:
                return False
            if next_left == next_right == -math.inf:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def matches(self, string: str, first: int) -> list[int]:
        """Length of the longest piece that begins at each of WINDOW positions from first on; 1 where there is none."""
        last = min(len(string), first + WINDOW)
        out = [1] * (last - first)
        for end, length in self.automaton.iter(string, first, min(len(string), last + self.longest - 1)):
            if end - length < last - 1:
                out[end - length + 1 - first] = length
        return out

    def split(self, string: str) -> list[str]:
        """The pieces of a normalised string. Unknown characters are pieces of their own."""
        size, goes, histories = len(string), self.goes, self.histories
        found, first, end_of_found = self.matches(string, 0), 0, min(size, WINDOW)
        out: list[str] = []
        failed: bytearray | None = None
        position, length, last = 0, 0, None
        while position < size:
            if not first <= position < end_of_found:
                first = position // WINDOW * WINDOW
                found, end_of_found = self.matches(string, first), first + WINDOW
            length = length or found[position - first]
            while length > 0:
                end = position + length
                piece = string[position:end]
                if (last is None or goes[last, piece]) and (failed is None or not failed[end >> 3] >> (end & 7) & 1):
                    break
                length -= 1
                while length > 1 and string[position : position + length] not in histories:
                    length -= 1
            if length > 0:
                out.append(piece if size <= CHUNK else histories.get(piece, (piece,))[-1][-1] if length > 1 else piece)
                position, last, length = end, piece, 0
                continue
            if failed is None:
                failed = bytearray(size // 8 + 1)
            failed[position >> 3] |= 1 << (position & 7)
            # give the last piece back for the next shorter one; -1 if there is none
            position -= len(last)
            length = len(last) - 1 or -1
            while length > 1 and string[position : position + length] not in histories:
                length -= 1
            out.pop()
            last = out[-1] if out else None
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids of a chunk, 32 bits each."""
        ids = self.ids
        if chunk in self.histories:
            return array("I", (ids[chunk],)).tobytes()
        found = self.split(chunk)
        try:
            return array("I", [ids[piece] for piece in found]).tobytes()
        except KeyError:
            return array("I", chain.from_iterable((ids[p],) if p in ids else [self.bytes[b] for b in p.encode()] for p in found)).tobytes()

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, without begin and end."""
        if not text:
            return []
        chunks, known, out = self.chunk.findall((" " + text).replace(" ", SPACE)), self.known, array("I")
        known.trim()
        self.goes.trim()
        if max(map(len, chunks)) > CHUNK:
            out.frombytes(b"".join(known[c] if len(c) <= CHUNK else self.encode_chunk(c) for c in chunks))
        else:
            out.frombytes(b"".join(map(known.__getitem__, chunks)))
        return out.tolist()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def pieces(name: str = TOKENIZER) -> Pieces:
    """The process's vocabulary for a file."""
    return worker_cache(("pieces", name), lambda: Pieces(name))


def encode_documents(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text: ids in order, and what decoding them gives.

    Null counts as empty, and empty texts have no ids. Rows keep their number: repeated rows and null ids come back as they are.
    Long texts are handled whole, in memory of a few bytes a character. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        for batch in batches:
            ids = [model.encode(t.as_py()) for t in batch.column("text")]
            decoded = [model.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode_documents, with digests in place of ids and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(name)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = model.encode(text.as_py())
                rows.append((len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
