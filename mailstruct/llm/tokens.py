"""Exact token ids of public tokenizers, at the speed of a vocabulary lookup.

The library spends most of its time on words that it has met before. For a vocabulary whose normaliser and splitter
drop white space, a text's ids are those of its white-space chunks in order; for a chunk of ASCII and Latin-1 they are
those of its letter runs, digits and symbol runs. Each distinct piece goes to the library once for each worker, and
batches are put together by array operations. All other chunks, and texts with separators on which Arrow and the library
differ, go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mailstruct.llm.common import worker_cache

#: The splitter that the word vocabulary's file states, and the white space that it drops. Fixed values.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks for which lower case, NFC and the pattern's classes agree between this code and the library.
SAFE = r"[\x21-\x7e\xa1-\xff]+"
#: Arrow splits on these; the library does not.
ODD = r"[\x1c-\x1f]"
#: Distinct chunks that a worker remembers before it starts anew.
REMEMBER = 400_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(name: str) -> str:
    """Digest of the tokenizer's file: two versions never share a count."""
    return hashlib.sha256(Path(tokenizer_path(name)).read_bytes()).hexdigest()


def drops_space(name: str) -> bool:
    """Whether runs of white space never change the ids, and words have ids of their own: for the one kind of file for which
    this code knows both, by its normaliser, splitter, model and added strings. All other files go to the library whole."""
    if not name.endswith(".json"):
        return False
    spec = json.loads(Path(tokenizer_path(name)).read_text())
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec.get("model") or {}
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": WORD_PATTERN}
        and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix") and not model.get("dropout")
        and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    )


def gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of n values of flat from first on, one after another, and where each begins (one more than the runs)."""
    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return flat[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])], ends


class Encoder:
    """ids for batches of whole texts, without begin, end or added special tokens, truncation or padding."""

    def __init__(self, name: str):
        import regex

        path = tokenizer_path(name)
        self.piece = name.endswith(".model")
        if self.piece:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
        self.by_word = drops_space(name)
        self.safe, self.odd, self.pattern = regex.compile(SAFE), regex.compile(ODD), regex.compile(WORD_PATTERN)
        self.chunks: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        if self.by_word:
            vocabulary = self.model.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers, from the library alone."""
        if self.piece:
            return [np.array(ids, "<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        plain = {w: self.pattern.findall(w.lower()) for w in words if self.safe.fullmatch(w) and "<|" not in w}
        self.learn_cores({c for cores in plain.values() for c in cores})
        core = self.cores.__getitem__
        self.chunks.update((w, b"".join(map(core, cores))) for w, cores in plain.items())
        other = [w for w in words if w not in plain]
        self.chunks.update(zip(other, self.whole(other), strict=True))

    def learn_cores(self, cores: Iterable[str]) -> None:
        if len(self.cores) > REMEMBER:
            self.cores.clear()
        new = [c for c in cores if c not in self.cores]
        letters = [c for c in new if c.isalpha()]
        for at in range(0, len(letters), 2000):
            some = letters[at : at + 2000]
            ids = self.whole([" ".join(some)])[0]
            cuts = (4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)).tolist()
            if len(cuts) == len(some):
                self.cores.update(zip(some, (ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))
        rest = [c for c in new if c not in self.cores]
        self.cores.update(zip(rest, self.whole(rest), strict=True))

    def cut(self, words: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Which distinct chunks are plain, all different pieces of these, and the plain chunks' pieces: numbers, and for each chunk its first's place and how many.

        Chunks are cut by array operations; only their pieces become objects, and new ones go to the library. A chunk may have an empty piece.
        """
        plain = pc.and_not(pc.match_substring_regex(words, rf"\A{SAFE}\z"), pc.match_substring(words, "<|"))
        lower = pc.utf8_lower(words.filter(plain))
        alone = pc.utf8_is_alpha(lower)
        parts = pc.split_pattern(pc.replace_substring_regex(lower.filter(pc.invert(alone)), f"({WORD_PATTERN})", "\\1\x1e"), "\x1e")
        coded = pa.concat_arrays([lower.filter(alone), parts.values]).dictionary_encode()
        cores = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn_cores(c for c in cores if c)
        is_plain, is_alone = (x.to_numpy(zero_copy_only=False) for x in (plain, alone))
        at, first, n = parts.offsets.to_numpy().astype(np.int64), np.empty(len(lower), np.int64), np.ones(len(lower), np.int64)
        first[is_alone], first[~is_alone], n[~is_alone] = np.arange(is_alone.sum()), is_alone.sum() + at[:-1], np.diff(at)
        return is_plain, cores, coded.indices.to_numpy(), first, n

    def other_ids(self, words: list[str]) -> list[bytes]:
        """The ids of chunks that aren't plain."""
        if len(self.chunks) > REMEMBER:
            self.chunks.clear()
        if missing := [w for w in words if w not in self.chunks and w]:
            self.learn(missing)
        return [self.chunks[w] if w else b"" for w in words]

    def chunk_sizes(self, words: pa.Array) -> np.ndarray:
        """Number of ids of each distinct chunk."""
        is_plain, cores, codes, first, n = self.cut(words)
        sizes = np.fromiter((len(self.cores[c]) // 4 if c else 0 for c in cores), np.int64, len(cores))
        total = np.concatenate([[0], np.cumsum(sizes[codes])])
        out = np.zeros(len(words), np.int64)
        out[is_plain] = total[first + n] - total[first]
        others = self.other_ids(words.filter(pa.array(~is_plain)).to_pylist())
        out[~is_plain] = np.fromiter((len(x) // 4 for x in others), np.int64, len(others))
        return out

    def chunk_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the distinct chunks, and where each chunk's begin (one more than the chunks)."""
        is_plain, cores, codes, first, n = self.cut(words)
        known = [self.cores[c] if c else b"" for c in cores]
        # a chunk that isn't plain is one piece
        others = self.other_ids(words.filter(pa.array(~is_plain)).to_pylist())
        codes = np.concatenate([codes, np.arange(len(cores), len(cores) + len(others))])
        place, pieces = np.empty(len(words), np.int64), np.ones(len(words), np.int64)
        place[is_plain], pieces[is_plain], place[~is_plain] = first, n, np.arange(len(codes) - len(others), len(codes))
        flat, _ = gathered(codes, place, pieces)
        known += others
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, ends = gathered(np.frombuffer(b"".join(known), "<u4"), (np.cumsum(sizes) - sizes)[flat], sizes[flat])
        return ids, ends[np.concatenate([[0], np.cumsum(pieces)])]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text. No nulls."""
        if not self.by_word:
            return np.array([len(x) // 4 for x in self.whole(texts.to_pylist())], np.int64)
        split = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
        starts, coded = split.offsets.to_numpy().astype(np.int64), pc.dictionary_encode(split.values)
        codes, sizes = coded.indices.to_numpy(), self.chunk_sizes(coded.dictionary)
        total = np.concatenate([[0], np.cumsum(sizes[codes])]) if len(codes) else np.zeros(1, np.int64)
        out = total[starts[1:]] - total[starts[:-1]]
        for i in self.odd_rows(texts):
            out[i] = len(self.whole([texts[i].as_py()])[0]) // 4
        return out

    def odd_rows(self, texts: pa.Array) -> list[int]:
        return np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)).tolist()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit), and where each text's begin (one more than the texts). No nulls."""
        odd = self.odd_rows(texts) if self.by_word else range(len(texts))
        if len(odd):
            each = self.whole(texts.to_pylist()) if not self.by_word else self._mixed(texts, set(odd))
            sizes = np.array([len(x) // 4 for x in each], np.int64)
            return np.frombuffer(b"".join(each), "<u4"), np.concatenate([[0], np.cumsum(sizes)])
        split = pc.utf8_split_whitespace(texts.cast(pa.large_string()))
        starts, coded = split.offsets.to_numpy().astype(np.int64), pc.dictionary_encode(split.values)
        codes, (known, first) = coded.indices.to_numpy(), self.chunk_ids(coded.dictionary)
        flat, ends = gathered(known, first[:-1][codes], np.diff(first)[codes])
        return flat, ends[starts]

    def _mixed(self, texts: pa.Array, odd: set[int]) -> list[bytes]:
        out = []
        for i in range(len(texts)):
            if i in odd:
                out += self.whole([texts[i].as_py()])
            else:
                out.append(self.ids(texts.slice(i, 1))[0].tobytes())
        return out


def encoder(name: str) -> Encoder:
    """The process's encoder for a tokenizer file."""
    return worker_cache(("encoder", name), lambda: Encoder(name))
