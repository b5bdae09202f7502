"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled rows, and all of their terms count. A term weighs by TF-IDF, with document
frequencies over all documents, times one and the square root of its chi square against the examples' labels: terms that
tell labels apart lead the search, and no term is without weight. A document's nearest examples are those of the largest
exact cosine of whole weight vectors, found through an inverted index with block maxima. Examples lie in blocks of alike ones.
Lists of rare terms are read whole; of the frequent terms' lists only the largest weight in each block is, at first: both
together bound what a block's examples can reach, and only blocks that can reach a document's k-th best are scored, for
documents of alike bounds together. What can be among the nearest within single precision is worked out again in full.
Neighbours vote with weights that fall with their distance, and a monotone map fitted on leave-one-out votes of the examples
turns votes into probabilities. All who vote are the evidence.

The index is bounded by the texts of SAMPLE examples; it is broadcast, and each Python worker holds a copy of it.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstruct.llm.common import Workspace, fold, forget, release, table, text_of, trim
from mailstruct.llm.rules import labelled

SAMPLE, NEIGHBOURS, THRESHOLD = 12_000, 15, 0.5
#: Terms whose lists have block maxima, examples of a block, blocks that a search scores before it has a k-th best, documents
#: that search together, and the bound of what single precision is off by.
FREQUENT, BLOCK, FIRST, TOGETHER, SLACK = 512, 16, 16, 128, 5e-5
#: Texts that are taken apart at a time.
SLICE = 512
#: Texts that a task remembers the neighbours of, and terms and examples that are worked on at a time to save memory.
TEXTS, CHUNK, EXAMPLES = 20_000, 1 << 15, 1024
TERM = re.compile(r"[^\W_]+")


class Vocabulary:
    """Distinct terms, numbered by their places. Strings lie in one Arrow array, and are found by a sorted array of their hashes.

    Hashes hold for one process, so they are derived where a vocabulary arrives; equal ones are told apart by the strings.
    """

    def __init__(self, terms: list[str]):
        self.terms = pa.array(terms, pa.large_string())
        self.derive()

    def __len__(self) -> int:
        return len(self.terms)

    def __getstate__(self) -> tuple[int, bytes]:
        text = pickle.dumps(self.terms)
        return len(text), pa.compress(text, "zstd", asbytes=True)

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.terms = pickle.loads(pa.decompress(state[1], state[0], "zstd"))
        self.derive()

    def derive(self) -> None:
        hashes = np.empty(len(self), np.int64)
        for at in range(0, len(self), CHUNK):
            some = self.terms.slice(at, CHUNK).to_pylist()
            hashes[at : at + CHUNK] = np.fromiter(map(hash, some), np.int64, len(some))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.order = hashes[order], order.astype(np.int32)

    def find(self, words: list[str]) -> np.ndarray:
        """The number of each word; -1 for words that aren't terms."""
        out, left = np.full(len(words), -1), np.arange(len(words))
        wanted, given = np.fromiter(map(hash, words), np.int64, len(words)), pa.array(words, pa.large_string())
        at = np.searchsorted(self.hashes, wanted)
        while len(left):
            inside = at < len(self.hashes)
            left, at = left[inside], at[inside]
            same = self.hashes[at] == wanted[left]
            left, at = left[same], at[same]
            number = self.order[at]
            equal = pc.equal(self.terms.take(pa.array(number)), given.take(pa.array(left))).to_numpy(zero_copy_only=False)
            out[left[equal]] = number[equal]
            left, at = left[~equal], at[~equal] + 1
        return out


class Terms:
    """Occurrences of known terms (or of all) in a batch of texts. A term is a run of letters and digits in lower case."""

    def __init__(self, vocabulary: Vocabulary | None):
        self.vocabulary = vocabulary
        self.names: list[str] = []
        self.size = 0 if vocabulary is None else len(vocabulary)

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many known terms each word holds, and their numbers, word by word."""
        if self.vocabulary is None:
            number: dict[str, int] = {}
            parts = [[number.setdefault(t, len(number)) for t in TERM.findall(w)] for w in words]
            self.names, self.size = list(number), len(number)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            return sizes, np.fromiter((i for p in parts for i in p), np.int64, int(sizes.sum()))
        # a word is one run, or runs with punctuation between
        whole = self.vocabulary.find(words)
        rest = np.flatnonzero(whole < 0)
        runs = [TERM.findall(words[i]) for i in rest.tolist()]
        found = self.vocabulary.find([t for r in runs for t in r])
        word = np.concatenate([np.flatnonzero(whole >= 0), np.repeat(rest, np.fromiter(map(len, runs), np.int64, len(runs)))])
        flat = np.concatenate([whole[whole >= 0], found])
        word, flat = word[flat >= 0], flat[flat >= 0]
        return np.bincount(word, minlength=len(words)), flat[np.argsort(word, kind="stable")]

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, occurrences), sorted by row and term."""
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
        coded = pc.dictionary_encode(split.values)
        sizes, flat = self.numbers(coded.dictionary.to_pylist())
        first = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        rows = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        some = sizes[codes] > 0
        codes, rows = codes[some], rows[some]
        n = sizes[codes]
        at = np.repeat(first[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs, tf = np.unique(np.repeat(rows, n) * (self.size + 1) + flat[at], return_counts=True)
        return pairs // (self.size + 1), pairs % (self.size + 1), tf


def spans(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of rows `of` of a table whose row i lies in starts[i]:starts[i + 1], and each row's count."""
    n = starts[of + 1] - starts[of]
    return np.repeat(starts[of] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


class Index:
    """Examples by their terms (terms and occurrences in row_starts), their rare terms by term (rows, own in term_starts), and the frequent terms as a matrix.

    Only the examples' terms and their occurrences are sent, compressed; the rest is derived where it arrives, some examples at a time.
    """

    SENT = ("row_starts", "terms", "tf", "idf", "ids", "labels")

    def __init__(self, vocabulary: list[str] | Vocabulary, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, row_starts: np.ndarray, terms: np.ndarray, tf: np.ndarray, prior: float):
        self.vocabulary, self.idf, self.ids, self.labels, self.row_starts, self.terms = vocabulary if isinstance(vocabulary, Vocabulary) else Vocabulary(vocabulary), idf, ids, labels, row_starts, terms
        self.tf = tf.astype(np.min_scalar_type(tf.max(initial=1)))
        self.prior, self.knots = prior, (np.zeros(1), np.array([prior]))
        self.derive()

    def __getstate__(self) -> dict:
        packed = {c: pickle.dumps(getattr(self, c)) for c in self.SENT}
        return {c: (len(x), pa.compress(x, "zstd", asbytes=True)) for c, x in packed.items()} | {"vocabulary": self.vocabulary, "prior": self.prior, "knots": self.knots}

    def __setstate__(self, state: dict) -> None:
        self.vocabulary, self.prior, self.knots = state["vocabulary"], state["prior"], state["knots"]
        for c in self.SENT:
            size, packed = state.pop(c)
            setattr(self, c, pickle.loads(pa.decompress(packed, size, "zstd")))
        self.derive()

    def derive(self) -> None:
        size, known = len(self.ids), len(self.vocabulary)
        self.loudness = 1 + np.log(np.maximum(np.arange(int(self.tf.max(initial=1)) + 1), 1))
        n = np.bincount(self.terms, minlength=known)
        often = np.argsort(-n, kind="stable")[:FREQUENT]
        often = often[n[often] > size // 100]
        self.dense = np.zeros(known)
        self.column = np.full(known, -1, np.int16)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((size, len(often)), np.float32)
        self.norms = np.empty(size)
        n[often] = 0
        self.term_starts = np.concatenate([[0], np.cumsum(n)])
        rows, own, done = np.empty(self.term_starts[-1], np.int32), np.empty(self.term_starts[-1], np.float32), 0
        for some in (slice(at, min(at + EXAMPLES, size)) for at in range(0, size, EXAMPLES)):
            row = np.repeat(np.arange(some.start, some.stop), np.diff(self.row_starts[some.start : some.stop + 1]))
            at = slice(self.row_starts[some.start], self.row_starts[some.stop])
            w = self.loudness[self.tf[at]] * self.idf[self.terms[at]]
            self.norms[some] = np.sqrt(np.bincount(row - some.start, w * w, some.stop - some.start))
            w /= self.norms[row]
            column = self.column[self.terms[at]]
            rare = column < 0
            self.matrix[row[~rare], column[~rare]] = w[~rare]
            end = done + int(rare.sum())
            rows[done:end], own[done:end], done = row[rare], w[rare], end
        by = np.argsort(self.terms[self.column[self.terms] < 0], kind="stable")
        self.rows, self.own = rows[by], own[by]
        self.block_starts = np.arange(0, size, BLOCK)
        self.maxima = np.maximum.reduceat(self.matrix, self.block_starts).T if size else np.zeros((len(often), 0), np.float32)
        self.scored = self.asked = 0

    @property
    def postings(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The examples of each term, and its weights in them; of frequent terms too."""
        out = list(zip(np.split(self.rows, self.term_starts[1:-1]), np.split(self.own, self.term_starts[1:-1]), strict=True))
        for term in np.flatnonzero(self.column >= 0):
            weights = self.matrix[:, self.column[term]]
            out[term] = np.flatnonzero(weights), weights[weights > 0]
        return out

    def weights(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The weights at places of terms, which lie in these rows."""
        return self.loudness[self.tf[at]] * self.idf[self.terms[at]] / self.norms[row]

    def vector(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def rare_part(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms without block maxima add to each vector's similarity with each example, in single precision."""
        out = np.empty((len(vectors), len(self.ids)), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            rare = self.column[terms] < 0
            at, counts = spans(self.term_starts, terms[rare])
            out[i] = np.bincount(self.rows[at], np.repeat(weights[rare], counts) * self.own[at], len(self.ids))
        return out

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, but: int = -1) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector (terms, weights) the k examples of largest cosine above 0 and their cosines, ties to the smaller id.

        With but, that of vector i leaves example but + i out.
        """
        size, out = len(self.ids), [(np.empty(0, np.int64), np.empty(0))] * len(vectors)
        if not size:
            return out
        frequent = np.zeros((len(vectors), self.matrix.shape[1]), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            at = self.column[terms]
            frequent[i, at[at >= 0]] = weights[at >= 0]
        bounds = frequent @ self.maxima
        alike = np.argsort(bounds.argmax(1), kind="stable")
        for first in range(0, len(vectors), TOGETHER):
            some = alike[first : first + TOGETHER]
            rare = self.rare_part([vectors[i] for i in some])
            if but >= 0:
                rare[np.arange(len(some)), but + some] = -2
            bound = bounds[some] + np.maximum.reduceat(rare, self.block_starts, axis=1)

            def visit(blocks: np.ndarray, some=some, rare=rare) -> tuple[np.ndarray, np.ndarray]:
                rows = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                rows = rows[rows < size]
                self.scored += len(rows) * len(some)
                return rows, rare[:, rows] + frequent[some] @ self.matrix[rows].T

            best = np.unique(np.argpartition(-bound, min(FIRST, bound.shape[1]) - 1, axis=1)[:, :FIRST])
            rows, score = visit(best)
            more = np.setdiff1d(np.flatnonzero((bound >= floor_of(score, k)[:, None]).any(0)), best)
            if len(more):
                rows, score = (np.concatenate(x, -1) for x in zip((rows, score), visit(more), strict=True))
            self.asked += size * len(some)
            least = floor_of(score, k)
            for i, row, floor in zip(some, score, least, strict=True):
                out[i] = self.best(*vectors[i], rows[(row >= floor) & (row > 0)], k)
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_all([(terms, weights)], k)[0]

    def best(self, terms: np.ndarray, weights: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the examples found, by cosines worked out in full."""
        at, counts = spans(self.row_starts, found)
        self.dense[terms] = weights
        exact = np.bincount(np.repeat(np.arange(len(found)), counts), self.dense[self.terms[at]] * self.weights(at, np.repeat(found, counts)), len(found))
        self.dense[terms] = 0
        found, exact = found[exact > 1e-8], exact[exact > 1e-8]
        best = np.lexsort((self.ids[found], -np.round(exact, 12)))[:k]
        return found[best], np.minimum(exact[best], 1.0)

    def vote(self, found: np.ndarray, similarity: np.ndarray) -> float:
        weight = 1 / (1.05 - similarity)
        return float((weight * self.labels[found]).sum() / weight.sum())

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.knots))


def floor_of(score: np.ndarray, k: int) -> np.ndarray:
    """What a row's k best are not below, in single precision; 0 if it has no more than k."""
    return np.maximum(np.partition(score, -k, axis=1)[:, -k] - 2 * SLACK, 0) if score.shape[1] > k else np.zeros(len(score))


def monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators; ends are pulled in as one row of each label would."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y in zip(votes[order], labels[order], strict=True):
        pools.append([float(y), 1.0, float(v)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, x = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, (pools[-1][2] * pools[-1][1] + x * n) / (pools[-1][1] + n)]
    x = np.array([p[2] for p in pools])
    return x, np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])


def joined(lists: pd.Series) -> np.ndarray:
    """The integers of all lists in one row."""
    return np.concatenate([np.empty(0, np.int32), *lists.map(np.asarray)]).astype(np.int64)


def parts(examples: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """Some examples at a time and the place of their first, so that the driver holds no second copy of all their terms."""
    return ((at, examples.iloc[at : at + EXAMPLES]) for at in range(0, len(examples), EXAMPLES))


def relevance(size: int, examples: pd.DataFrame) -> np.ndarray:
    """How much each of so many terms tells the examples' labels apart: 1 and the root of its chi square, so that no term is without weight."""
    n, positive = float(len(examples)), float(examples.y.sum())
    if not 0 < positive < n:
        return np.ones(size)
    seen, a = np.zeros(size), np.zeros(size)
    for _, some in parts(examples):
        flat = joined(some.terms)
        seen += np.bincount(flat, minlength=size)
        a += np.bincount(flat, np.repeat(some.y.to_numpy(float), some.terms.map(len)), size)
    odds = a * (n - positive - (seen - a)) - (seen - a) * (positive - a)
    spread = seen * (n - seen) * positive * (n - positive)
    return 1 + np.sqrt(np.divide(n * odds * odds, spread, out=np.zeros(size), where=spread > 0))


def by_likeness(examples: pd.DataFrame, idf: np.ndarray) -> np.ndarray:
    """An order of the examples in which alike ones lie together: halves along the widest of their frequent terms' main directions."""
    seen = np.zeros(len(idf), np.int64)
    for _, some in parts(examples):
        seen += np.bincount(joined(some.terms), minlength=len(idf))
    often = np.argsort(-seen, kind="stable")[:FREQUENT]
    column = np.full(len(idf), -1)
    column[often] = np.arange(len(often))
    held = np.zeros((len(examples), len(often)))
    for first, some in parts(examples):
        flat = joined(some.terms)
        row = np.repeat(np.arange(len(some)), some.terms.map(len).to_numpy(np.int64))
        w = (1 + np.log(joined(some.tf))) * idf[flat]
        w /= np.sqrt(np.bincount(row, w * w, len(some)))[row]
        at = column[flat]
        held[first + row[at >= 0], at[at >= 0]] = w[at >= 0]
    held -= held.mean(0)
    places = held @ np.linalg.eigh(held.T @ held)[1][:, -8:]
    out, left = [], [np.arange(len(examples))]
    while left:
        some = left.pop()
        if len(some) <= BLOCK:
            out.append(some)
            continue
        some = some[np.argsort(places[some, places[some].std(0).argmax()], kind="stable")]
        half = -(-(len(some) // 2) // BLOCK) * BLOCK
        left += [some[half:], some[:half]]
    return np.concatenate(out)


def build(vocabulary: list[str] | Vocabulary, df: np.ndarray, n_docs: int, examples: pd.DataFrame) -> Index:
    """examples: doc_id, y, terms, tf; the prior is the share of toxic examples."""
    idf = (np.log((1 + n_docs) / (1 + df)) + 1) * relevance(len(vocabulary), examples)
    prior = float((examples.y.sum() + 0.5) / (len(examples) + 1))
    some = examples[examples.terms.map(len) > 0].sort_values("doc_id")
    del examples
    if len(some):
        some = some.iloc[by_likeness(some, idf)]
    flat = [np.concatenate([np.empty(0, np.int32), *some[c].map(np.asarray)]).astype(np.int32, copy=False) for c in ("terms", "tf")]
    row_starts = np.concatenate([[0], np.cumsum(some.terms.map(len).to_numpy(np.int64))])
    ids, labels = some.doc_id.to_numpy(np.int64), some.y.to_numpy(float)
    del some
    index = Index(vocabulary, idf, ids, labels, row_starts, *flat, prior)
    del flat
    votes = np.full(len(ids), np.nan)
    for first in range(0, len(ids), EXAMPLES):
        rows = range(first, min(first + EXAMPLES, len(ids)))
        places = [np.arange(row_starts[i], row_starts[i + 1]) for i in rows]
        vectors = [(index.terms[at], index.weights(at, i)) for i, at in zip(rows, places, strict=True)]
        for i, near in zip(rows, index.nearest_all(vectors, NEIGHBOURS, but=first), strict=True):
            votes[i] = index.vote(*near) if len(near[0]) else np.nan
    known = ~np.isnan(votes)
    if known.any():
        index.knots = monotone(votes[known], index.labels[known])
    return index


def text_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each batch."""
    for batch in batches:
        terms = Terms(None)
        terms.counts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(terms.names, pa.string())], ["term"])


VECTOR = "terms array<int>, tf array<int>"


def vector_rows(vocabulary: Vocabulary, keep: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    terms = Terms(vocabulary)
    for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        rows, numbers, tf = terms.counts(batch.column("_text"))
        cuts = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (numbers, tf)]
        del rows, numbers, tf
        trim()
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *lists], [*keep, "terms", "tf"])


def shape_of(docs: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), more])


def with_text(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(*(F.col(f"`{c}`") for c in keep), text_of().alias("_text"))


def vectorise(docs: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """Columns of docs to keep, and the numbers (ascending) and occurrences of the terms of its text; null counts as empty."""
    return with_text(docs, keep).mapInArrow(lambda batches: vector_rows(vocabulary, keep, batches), shape_of(docs, keep, VECTOR))


def train_on(docs: DataFrame, labels: DataFrame, work: Workspace, keep: list[str], target: str = "toxic", sample: int = SAMPLE) -> tuple[Index, DataFrame]:
    """The index of at most sample labelled rows of docs (doc_id, text) outside the held-out fold, and the vectors of all docs
    with their columns to keep, written: document frequencies are counted there, and texts need not be read again."""
    rows = work.write(labelled(docs, labels, target, sample).select(F.col("doc_id").cast("long"), F.col("y").cast("long"), "text"), "examples")
    held = Vocabulary(sorted(rows.mapInArrow(text_terms, "term string").distinct().toArrow().column("term").to_pylist()))
    vectors = work.write(vectorise(docs, held, keep), "vectors")
    counts = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()
    df = np.zeros(len(held))
    df[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    del counts
    release()
    n_docs = vectors.count()
    index = build(held, df, n_docs, vectorise(rows, held, ["doc_id", "y"]).toArrow().to_pandas())
    release()
    return index, vectors


def train(docs: DataFrame, labels: DataFrame, work: Workspace, target: str = "toxic", sample: int = SAMPLE) -> Index:
    return train_on(docs, labels, work, [], target, sample)[0]


def scorer(held: Broadcast[Index], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds score and evidence to rows of vectors; equal vectors are searched for once."""
        index, known = held.value, {}
        for batch in batches:
            terms, tf = batch.column("terms"), batch.column("tf")
            cuts, numbers, tf = terms.offsets.to_numpy() - terms.offsets[0].as_py(), terms.flatten().to_numpy(), tf.flatten().to_numpy()
            keys = [hashlib.blake2b(numbers[a:b].tobytes() + tf[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if len(known) > TEXTS:
                known.clear()
            new = {key: (a, b) for key, a, b in zip(keys, cuts[:-1], cuts[1:], strict=True) if key not in known}
            vectors = [(numbers[a:b], index.vector(numbers[a:b], tf[a:b])) for a, b in new.values()]
            for key, (found, near) in zip(new, index.nearest_all(vectors, NEIGHBOURS), strict=True):
                known[key] = (index.calibrated(index.vote(found, near)) if len(found) else index.prior), found, near
            score = pa.array([known[key][0] for key in keys], pa.float64())
            found, near = (np.concatenate([np.empty(0, kind), *(known[key][i] for key in keys)]) for i, kind in ((1, np.int64), (2, float)))
            ends = np.concatenate([[0], np.cumsum([len(known[key][1]) for key in keys])]).astype(np.int32)
            voters = pa.StructArray.from_arrays([pa.array(index.ids[found]), pa.array(near), pa.array(index.labels[found].astype(np.int32))], ["example", "similarity", "label"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), score, pa.ListArray.from_arrays(pa.array(ends), voters)], [*names, "score", "evidence"])

    return run


SCORED = "score double, evidence array<struct<example: long, similarity: double, label: int>>"


def predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_vectors(vectors: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of vectorise() with score, evidence and predicted in place of the vectors."""
    keep = [c for c in vectors.columns if c not in ("terms", "tf")]
    held = vectors.sparkSession.sparkContext.broadcast(index)
    return predicted(vectors.mapInArrow(scorer(held, keep), shape_of(vectors, keep, SCORED)), threshold)


def score(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of docs with score (probability of being toxic), evidence (the examples that vote, with similarity
    and label) and predicted. One Python pass.

    Null texts count as empty; texts without any of the index's terms, empty ones too, get the share of toxic examples
    and no evidence. Very long texts are read whole. Equal texts get equal scores; columns of docs named like the results
    are replaced.
    """
    keep = [c for c in docs.columns if c not in ("score", "evidence", "predicted", "terms", "tf")]
    held = docs.sparkSession.sparkContext.broadcast(index)
    run = scorer(held, keep)
    return predicted(with_text(docs, keep).mapInArrow(lambda batches: run(vector_rows(held.value.vocabulary, keep, batches)), shape_of(docs, keep, SCORED)), threshold)


def op8_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index, vectors = train_on(docs, table(spark, sf_dir, "labels"), Workspace(spark), ["doc_id"])
    return score_vectors(vectors, index).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "evidence")
