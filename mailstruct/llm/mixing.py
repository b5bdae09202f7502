"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is a number of words. Whole epochs cover what they can; for the rest, documents are counted by exact
length, every length gives its even share, and bounded-knapsack dynamic programming over the spare counts hits what budget
remains. The counts are then turned into documents by a seeded order within each (source, length).

Only (source, length) counts leave the executors' tasks as groups: a group's size is bounded by the number of different
lengths. Ranks within a (source, length) are taken in about sqrt(n) hash buckets of about sqrt(n) rows each, so one length
that holds a third of all rows lands in many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailstruct.llm.common import Workspace, table, text_of

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, 17
#: The dynamic programme gets so many times the median length, and more where that misses; all of a budget up to so many words
#: by an array, and up to so many by bits.
REACH, LONGEST, WHOLE = 4, 1 << 22, 1 << 26
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, epochs: float = EPOCHS) -> list[float]:
    """Splits share * sum(sizes) by weight; whatever exceeds epochs times a source's size goes to the others by weight."""
    caps = [epochs * float(s) for s in sizes]
    out, open_ = [0.0] * len(caps), set(range(len(caps)))
    left = share * float(sum(sizes))
    while open_:
        total = float(sum(weights[i] for i in open_))
        full = [i for i in open_ if left * weights[i] / total >= caps[i]] if total else list(open_)
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = caps[i]
        open_ -= set(full)
        left = max(0.0, left - sum(caps[i] for i in full))
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length, so that their words come as near budget as the counts allow; ties go below.

    Even shares first, but for a reach of a few of the longest documents, which the dynamic programme decides exactly. If it
    misses the budget, the reach grows until it hits, or until it is all of the budget. A budget above LONGEST words that is
    still missed is decided by all sums as bits. The nearest sum of all is then known if the budget is WHOLE words at most, in
    units of the lengths' common divisor; of larger ones that no reach hits, the nearest sum met is taken.
    """
    counts = counts.astype(np.int64)
    unit = int(np.gcd.reduce(lengths))
    lengths = lengths // unit
    total = int((lengths * counts).sum())
    if budget >= total * unit:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    budget, over = divmod(budget, unit)
    order, longest = np.random.default_rng(seed).permutation(len(lengths)), np.argsort(-lengths, kind="stable")
    keep = reach = REACH * int(np.median(lengths))
    best, missed = counts, math.inf
    while missed:
        # an even share of all but the reach, long documents into what is left of it, and the programme for the rest
        taken = np.floor(counts * (max(0, budget - reach) / total)).astype(np.int64)
        left = budget - int((taken * lengths).sum())
        exact = reach >= budget and budget <= LONGEST
        for i in [] if exact else longest:
            more = min(int(counts[i] - taken[i]), max(0, left - keep) // int(lengths[i]))
            taken[i] += more
            left -= more * int(lengths[i])
        added, off = knapsack(lengths, counts - taken, left, over / unit, order)
        if (off, int((lengths * (taken + added)).sum())) < (missed, int((lengths * best).sum())):
            best, missed = taken + added, off
        if exact or reach >= budget:
            break
        reach = min(16 * reach, budget) if 16 * reach <= LONGEST or budget <= LONGEST else budget
    if missed and LONGEST < budget <= WHOLE:
        whole, off = all_sums(lengths, counts, budget, over / unit, order, math.ceil(missed))
        if (off, int((lengths * whole).sum())) < (missed, int((lengths * best).sum())):
            best = whole
    return best


def knapsack(lengths: np.ndarray, spare: np.ndarray, budget: int, over: float, order: np.ndarray) -> tuple[np.ndarray, float]:
    """(count of each length, distance, 0 if none can be nearer): the sum of at most spare documents of each length that is nearest budget + over.

    first[s] is the bundle of documents that made the sum s first, so sums are unwound from it. One array of twice the
    budget's length, since a sum beyond that is farther than none; over is less than 1, so a sum that is the budget is nearest
    but for the next, which is so only if over is above a half.
    """
    top = min(2 * budget + 1, int((lengths * spare).sum()))
    goal = budget + (over > 0.5)
    first = np.full(top + 1, -1, np.int32)
    first[0] = 0
    bundles = [(0, 0)]
    for i in order:
        left, some = int(spare[i]), 1
        while left > 0 and not (goal <= top and first[goal] >= 0):
            some = min(some, left)
            weight = some * int(lengths[i])
            if weight > top:
                break
            new = np.flatnonzero((first[:-weight] >= 0) & (first[weight:] < 0)) + weight
            first[new] = len(bundles)
            bundles.append((int(i), some))
            left, some = left - some, some * 2
    sums = np.flatnonzero(first >= 0)
    best = at = int(sums[np.lexsort((sums, np.abs(sums - budget - over)))[0]])
    added = np.zeros(len(lengths), np.int64)
    while at:
        i, some = bundles[first[at]]
        added[i] += some
        at -= some * int(lengths[i])
    return added, abs(best - budget - over) if best != goal else 0.0


def all_sums(lengths: np.ndarray, counts: np.ndarray, budget: int, over: float, order: np.ndarray, missed: int) -> tuple[np.ndarray, float]:
    """As knapsack, where a sum is known that is no more than missed away: bit s of a number tells whether s can be reached.

    A number takes an eighth of a byte for each word. Its history isn't kept: a sum is unwound by halves of the bundles, whose
    sums are added up again, so that a number for each halving is held.
    """
    top, goal = budget + missed, budget + (over > 0.5)
    mask, bundles, sums = (1 << (top + 1)) - 1, [], 1
    for i in order:
        left, some = int(counts[i]), 1
        while left > 0 and not sums >> goal & 1:
            some = min(some, left)
            if some * int(lengths[i]) > top:
                break
            bundles.append((int(i), some))
            sums |= sums << some * int(lengths[i]) & mask
            left, some = left - some, some * 2
    below = (sums & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = sums >> (budget + 1)
    near = [below, *([budget + (above & -above).bit_length()] if above else [])]
    best = min(near, key=lambda s: (abs(s - budget - over), s))
    added = np.zeros(len(lengths), np.int64)

    def unwind(sums: int, some: list[tuple[int, int]], at: int) -> int:
        """What is left of at, a sum of sums and these bundles, without those of them that make it."""
        if len(some) == 1:
            i, n = some[0]
            if sums >> at & 1:
                return at
            added[i] += n
            return at - n * int(lengths[i])
        half, middle = len(some) // 2, sums
        for i, n in some[:half]:
            middle |= middle << n * int(lengths[i]) & mask
        return unwind(sums, some[:half], unwind(middle, some[half:], at))

    if bundles:
        unwind(1, bundles, best)
    return added, abs(best - budget - over) if best != goal else 0.0


def plan_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Epochs for all, and documents with one more, of each length of one source."""
    rows = rows.sort_values("size").reset_index(drop=True)
    target, size = rows.target[0], rows.source_size[0]
    base = int(min(target // size, rows.epochs[0])) if size else 0
    lengths, counts = rows["size"].to_numpy(np.int64), rows.n.to_numpy(np.int64)
    some = lengths > 0
    more = np.zeros(len(rows), np.int64)
    if base < rows.epochs[0] and some.any():
        more[some] = fit(lengths[some], counts[some], round(target - base * size), int(rows.seed[0]))
    return rows.assign(base=base, more=more)[["source_key", "size", "n", "base", "more"]]


def mix(docs: DataFrame, work: Workspace, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target and epochs (how often the mix repeats the document) for every row of docs.

    Sources by code point, null last, take the weights in turn. Their totals (about 100 bytes a source) are planned on the
    driver, which is meant for up to a million sources; nothing else is. Null and empty texts have size 0 and are not taken.
    Very long texts take part in the knapsack whole, in arrays of some times their words. Budgets are met as near as can be
    up to WHOLE words and wherever a sum hits them; see fit. Repeated rows are separate
    documents. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("source_key")
    sized = work.write(docs.select("doc_id", "source", key, words_of(text_of(text)).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h")), "sized")
    counts = work.write(sized.groupBy("source_key", "size").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()
    totals.sort(key=lambda r: (r.source_key == "", r.source_key.encode("utf-8")))
    planned = targets([r.source_size for r in totals], [weights[i % len(weights)] for i in range(len(totals))], share, epochs)
    sources = spark.createDataFrame([(r.source_key, r.source_size, t, epochs, seed + i) for i, (r, t) in enumerate(zip(totals, planned, strict=True))], "source_key string, source_size long, target double, epochs int, seed long")
    plan = counts.join(sources, "source_key").groupBy("source_key").applyInPandas(plan_source, "source_key string, size long, n long, base int, more long")
    plan = work.write(plan.join(sources.select("source_key", "source_size", "target"), "source_key"), "plan")

    # merged at every size: the plan grows with the number of different lengths, and Spark splits a hot (source, length)
    rows = work.write(sized.join(plan.hint("merge"), ["source_key", "size"]), "rows")
    bucket = F.pmod(F.col("h"), F.ceil(F.sqrt("n"))).alias("bucket")
    split = rows.where((F.col("more") > 0) & (F.col("more") < F.col("n"))).select("*", bucket)
    group = ["source_key", "size", "bucket"]
    before = split.groupBy(*group).agg(F.count("*").alias("here"))
    so_far = Window.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*group, F.coalesce(F.sum("here").over(so_far), F.lit(0)).alias("before"))
    # a partitioning by (source, size) would satisfy the window too, and put a hot length in one task
    ranked = split.repartition(*group).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("h", "doc_id")))
    ranked = ranked.join(before.hint("merge"), group).withColumn("extra", (F.col("before") + F.col("rank") <= F.col("more")).cast("int"))
    even = rows.where((F.col("more") <= 0) | (F.col("more") >= F.col("n"))).withColumn("extra", (F.col("more") > 0).cast("int"))
    out = ["doc_id", "source", "size", "source_size", "target", (F.col("base") + F.col("extra")).alias("epochs")]
    return ranked.select(*out).unionAll(even.select(*out))


def op9_budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), Workspace(spark))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "source", "epochs")
