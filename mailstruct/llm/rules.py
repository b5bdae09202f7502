"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees on a bounded sample of labelled rows give candidate rules (every path from a root is a conjunction of
comparisons); a lasso logistic regression keeps few of them; what is kept is compiled into one Spark column expression over
the statistics, which one Arrow pass reads off the bytes of whole batches. Scoring is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mailstruct.llm.common import fold, forget, table, text_of

#: Labelled rows that fitting may use, chosen by a hash of their ids.
SAMPLE = 12_000
TREES, DEPTH, RATE, BINS, LEAF, LASSO, THRESHOLD = 40, 3, 0.3, 32, 20, 0.002, 0.3


NAMES = ("chars", "word_length", "upper", "symbols", "digits", "different_words", "repeated_words", "different_lines", "line_words")
#: ASCII punctuation of ordinary prose; all other ASCII punctuation counts as symbols.
PROSE = ".,;:!?'()-\""


def byte_classes() -> np.ndarray:
    """Per byte: 1 for ASCII capitals, 2 for symbols, 4 for digits, 16 for white space."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] = (1 if "A" <= c <= "Z" else 2 if "!" <= c <= "~" and not c.isalnum() and c not in PROSE else 4 if "0" <= c <= "9" else 16 if c == " " or 9 <= b <= 13 else 0) if b < 128 else 0
    return out


def different(split: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of strings: how many that aren't empty, how many different of these, and how many that equal the one before."""
    coded = pc.dictionary_encode(split.values)
    codes, starts = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    codes, row = codes[real], row[real]
    pairs = np.unique(row * (len(coded.dictionary) + 1) + codes)
    again = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row, minlength=n), np.bincount(pairs // (len(coded.dictionary) + 1), minlength=n), np.bincount(row[1:][again], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for each text (no nulls); an empty text has 0 for all. Capitals are those of ASCII and Latin-1."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    n = len(texts)
    if not n:
        return np.zeros((0, len(NAMES)))
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kinds = byte_classes()[data]
    accented = np.zeros(len(data), bool)  # capitals from U+00C0 to U+00DE
    accented[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)

    def per_text(hits: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(hits), offsets)).astype(float)

    chars = pc.utf8_length(texts).to_numpy().astype(float)
    words, distinct, repeated = different(pc.utf8_split_whitespace(texts))
    lines, distinct_lines, _ = different(pc.split_pattern(texts, "\n"))
    spaces = per_text(kinds == 16)
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    return np.stack(
        [chars, share(chars - spaces, words), share(per_text((kinds == 1) | accented), chars), share(per_text(kinds == 2), chars), share(per_text(kinds == 4), chars),
         share(distinct, words), share(repeated, words), share(distinct_lines, lines), share(words, lines)], 1)


STATISTICS = ", ".join(f"{n} double" for n in NAMES)


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """struct row (the columns of df to keep) and the statistics of its text; null counts as empty. One Arrow pass."""
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), text_of(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = statistics(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(found[:, i]) for i in range(len(NAMES)))], ["row", *NAMES])

    return held.mapInArrow(run, StructType([held.schema["row"], *(StructField(n, DoubleType()) for n in NAMES)]))


@dataclass(frozen=True)
class Rule:
    """A conjunction: statistic number, whether it must be above, and the cut."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, cut in self.tests:
            out &= (x[:, i] > cut) if above else (x[:, i] <= cut)
        return out

    def column(self) -> Column:
        out = None
        for i, above, cut in self.tests:
            test = F.col(NAMES[i]) > F.lit(cut) if above else F.col(NAMES[i]) <= F.lit(cut)
            out = test if out is None else out & test
        return out


@dataclass
class Ensemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """The probability of label 1, from columns named as the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """At most BINS - 1 cuts for each statistic, between its quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]


def grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, found: list[tuple], step: np.ndarray) -> None:
    """One regression tree on gradients; every node's path is a candidate rule, and leaves move step."""
    best, where = 1e-9, None
    if depth and len(rows) >= 2 * LEAF:
        gs, hs, n = g[rows].sum(), h[rows].sum(), len(rows)
        for i, cut in enumerate(cuts):
            if not len(cut):
                continue
            b, size = binned[rows, i], len(cut) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < LEAF) | (n - nl < LEAF)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], (i, k)
    if where is None:
        step[rows] += -RATE * g[rows].sum() / (h[rows].sum() + 1)
        return
    i, k = where
    left = binned[rows, i] <= k
    for side, above in ((rows[left], False), (rows[~left], True)):
        longer = (*path, (i, above, float(cuts[i][k])))
        found.append(longer)
        grow(binned, cuts, g, h, side, depth - 1, longer, found, step)


def simplified(path: tuple) -> Rule:
    """The tightest comparison for each statistic and direction."""
    tight: dict[tuple[int, bool], float] = {}
    for i, above, cut in path:
        old = tight.get((i, above))
        tight[i, above] = cut if old is None else (max if above else min)(old, cut)
    return Rule(tuple(sorted((i, above, cut) for (i, above), cut in tight.items())))


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty, by accelerated proximal gradients; columns of r are 0 or 1."""
    scale = np.sqrt(np.maximum(r.mean(0) * (1 - r.mean(0)), 1e-4)).astype(np.float32)
    z = ((r - r.mean(0)) / scale).astype(np.float32)
    p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    w, b = np.zeros(z.shape[1], np.float32), np.log(p / (1 - p))
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    rate = 4 * len(y) / (float(np.linalg.norm(z @ v)) ** 2 * 1.1 + 1e-9)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(z @ ahead + b))) - y
        b -= error.mean()
        new = ahead - rate * (z.T @ error.astype(np.float32)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (old - 1) / t * (new - w), new
    weights = w / scale
    return float(b - (weights * r.mean(0)).sum()), weights


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Trees, rules, and their lasso weights. Without both labels the score is the labels' smoothed mean."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(p / (1 - p))))
    cuts = cuts_of(x)
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    margin, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        grow(binned, cuts, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), paths, step)
        margin += step
    rules = sorted({simplified(p) for p in paths}, key=lambda r: r.tests)
    held, columns = {}, []
    for rule in rules:  # rules that hold for the same rows are one
        column = rule.holds(x)
        if 0 < column.sum() < len(y) and column.tobytes() not in held:
            held[column.tobytes()] = rule
            columns.append(column)
    if not columns:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))))
    b, w = lasso(np.stack(columns, 1).astype(np.float32), y.astype(np.float32), LASSO)
    some = np.flatnonzero(np.abs(w) > 1e-4)
    kept = list(held.values())
    return Ensemble(b, [kept[i] for i in some], [float(w[i]) for i in some])


def labelled(docs: DataFrame, labels: DataFrame, target: str, sample: int) -> DataFrame:
    """Documents with a label outside the held-out fold: at most sample of them, by a hash of the id (doc_id, text, y)."""
    chosen = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = chosen.groupBy("doc_id").agg(F.max(F.col(target)).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Ensemble:
    rows = labelled(docs, labels, target, sample)
    found = with_statistics(rows, ["doc_id", "y"]).select("row.doc_id", "row.y", *NAMES).toPandas().sort_values(["doc_id", *NAMES])
    return fit(found[list(NAMES)].to_numpy(float), found["y"].to_numpy(float))


def score(docs: DataFrame, model: Ensemble, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows of docs with their columns (or those to keep), score (probability of label 1) and predicted.

    Null texts count as empty; empty texts have all statistics 0 and get the score of the rules that hold then. Columns of
    docs named like the statistics or the results are shadowed within this function only; score and predicted are replaced.
    """
    keep = [c for c in keep or docs.columns if c not in ("score", "predicted")]
    scored = with_statistics(docs, keep, text).select("row", model.column().alias("score"))
    return scored.select(*(F.col("row").getField(c).alias(c) for c in keep), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    # the text is read, but not carried through Python
    return score(docs, model, keep=["doc_id"]).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
