"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on m random lines; each line keeps its projections sorted. A query counts, line by line, which
vectors fall in a window centred on its own projection. Windows grow by virtual rehashing: the radius is multiplied and only
the new ends of each window are read. Vectors that collide on at least a threshold of lines are verified by their exact
distance, all of them and no others. The search ends when the k-th best verified distance (or a bound on it that is known
already) is within the radius: lines and threshold are dimensioned so that every vector within the radius is verified but
for a stated chance, and one RATIO times as far is so for a stated share only.

Rows lie in slabs along the widest direction of a bounded sample, and slabs in blocks with sorted lines of their own. A
query first searches its home slab. The k-th distance found there bounds its search elsewhere: slabs farther away along the
direction are not visited, since no projection is longer than the distance, and windows in the others grow to that bound at
most. How many slabs that spares is a matter of the vectors; README has figures.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailstruct.llm.common import Workspace, table

K, EVERY, SEED = 10, 100, 5
#: Vectors of a block, queries that meet a block in one task, rows that slabs are cut by, and slabs at most.
BLOCK, QUERIES, PILOT, SLABS = 4096, 1024, 4096, 256
#: Window width for radius 1, growth of the radius, chance to miss a vector within the radius, share of vectors RATIO times as far let through.
WIDTH, GROWTH, MISS, RATIO, FAR = 2.0, 1.12, 0.2, 1.2, 0.02
#: Vectors of a block whose exact distances tell a query where to begin.
BEGIN = 32


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors so far apart differ by at most width / 2 on a random line."""
    return math.erf(width / (2 * math.sqrt(2) * distance))


def at_least(lines: int, p: float) -> np.ndarray:
    """Probabilities that 0, 1, ... of so many lines collide, or more."""
    n = np.arange(lines + 1)
    log = np.array([math.lgamma(lines + 1) - math.lgamma(i + 1) - math.lgamma(lines - i + 1) for i in n])
    return np.cumsum(np.exp(log + n * math.log(p) + (lines - n) * math.log1p(-p))[::-1])[::-1]


@lru_cache
def dimension(ratio: float = RATIO, width: float = WIDTH, miss: float = MISS, far: float = FAR) -> tuple[int, int]:
    """(lines, threshold): the fewest lines for which one threshold keeps both promises, by the binomial distribution."""
    near, beyond, lines = collision(1.0, width), collision(ratio, width), 8
    while True:
        found = np.flatnonzero((1 - at_least(lines, near) <= miss) & (at_least(lines, beyond) <= far))
        if len(found):
            return lines, int(found[-1])
        lines += 1


def directions(lines: int, dim: int) -> np.ndarray:
    """Gaussian lines in groups of dim that are orthogonal to each other: each is as random alone, and counts vary less."""
    random, out = np.random.default_rng(SEED), []
    for _ in range(-(-lines // dim)):
        q, r = np.linalg.qr(random.standard_normal((dim, dim)))
        out.append((q * np.sign(np.diag(r))).T * np.sqrt(random.chisquare(dim, dim))[:, None])
    return np.concatenate(out)[:lines]


@dataclass
class Lines:
    """Sorted projections of a block's vectors: line after line in one ascending array, each shifted past the line before."""

    ids: np.ndarray
    vectors: np.ndarray
    directions: np.ndarray
    shift: np.ndarray
    values: np.ndarray
    order: np.ndarray
    threshold: int

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray) -> Lines:
        m, threshold = dimension()
        along = directions(m, vectors.shape[1])
        projected = along @ vectors.T
        order = np.argsort(projected, axis=1, kind="stable")
        sorted_ = np.take_along_axis(projected, order, 1)
        shift = np.arange(m) * (4 * float(np.abs(projected).max()) + 1)
        return Lines(ids, vectors, along, shift, (sorted_ + shift[:, None]).ravel(), order.ravel(), threshold)

    def distances(self, query: np.ndarray, some: np.ndarray) -> np.ndarray:
        gap = self.vectors[some] - query
        return np.sqrt((gap * gap).sum(1))

    def nearest(self, query: np.ndarray, own: int, k: int, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and distances of the k nearest found, ties to the smaller id, and how many vectors were verified.

        With a bound only vectors within it are looked for.
        """
        n, m = len(self.ids), len(self.shift)
        first = np.arange(m) * n
        center = self.directions @ query + self.shift
        low = np.clip(np.searchsorted(self.values, center), first, first + n)
        high = low.copy()
        count, open_ = np.zeros(n, np.int64), self.ids != own
        found, distance = np.empty(0, np.int64), np.empty(0)
        # rounding moves projections of equal vectors by less than this
        least = 1e-9 * (1 + float(np.linalg.norm(query)))
        if math.isfinite(bound):
            radius = max(bound, least)  # nothing is sought but what the bound lets in
        else:
            # half of the least distance met
            some = np.unique(np.linspace(0, n - 1, min(n, BEGIN)).astype(np.int64))
            found = some[open_[some]]
            open_[found] = False
            distance = self.distances(query, found)
            radius = max(float(distance.min(initial=math.inf)) / 2, least)
        if not math.isfinite(radius):
            return found, distance, 0
        while True:
            half = radius * WIDTH / 2
            a = np.minimum(np.clip(np.searchsorted(self.values, center - half, side="left"), first, first + n), low)
            b = np.maximum(np.clip(np.searchsorted(self.values, center + half, side="right"), first, first + n), high)
            ends = [self.order[x:y] for x, y in zip(np.concatenate([a, high]).tolist(), np.concatenate([low, b]).tolist(), strict=True) if x < y]
            low, high = a, b
            if ends:
                count += np.bincount(np.concatenate(ends), minlength=n)
            fresh = np.flatnonzero((count >= self.threshold) & open_)
            open_[fresh] = False
            found, distance = np.concatenate([found, fresh]), np.concatenate([distance, self.distances(query, fresh)])
            enough = min(bound, float(np.partition(distance, k - 1)[k - 1])) if len(distance) >= k else bound
            if radius >= enough or not open_.any():
                break
            radius = min(radius * GROWTH, max(enough, radius * 1.0001))
        best = np.lexsort((self.ids[found], distance))[:k]
        return found[best], distance[best], len(found)


def placer(plan: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable:
    """Adds each vector's place along its length's direction, and its slab between the edges."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, flat = batch.column("dim").to_numpy(), batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            starts, along, slab = np.cumsum(dims) - dims, np.zeros(len(dims)), np.zeros(len(dims), np.int32)
            for dim in set(np.unique(dims).tolist()) & plan.keys():
                rows = np.flatnonzero(dims == dim)
                along[rows] = flat[starts[rows][:, None] + np.arange(dim)] @ plan[dim][0]
                slab[rows] = np.searchsorted(plan[dim][1], along[rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along), pa.array(slab)], [*batch.schema.names, "along", "slab"])

    return place


FOUND = "query_id long, vec_id long, score double, verified long"


def searcher(k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (dim, slab, block, part, is_query): a block's vectors, then the queries that meet it."""
        key, lines, ids, vectors, out = None, None, [], [], []

        def found() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["query_id", "vec_id", "score", "verified"])

        for batch in batches:
            flat, at = batch.column("embedding").flatten().to_numpy(zero_copy_only=False), 0
            for *now, is_query, vec_id, bound in zip(*(batch.column(c).to_pylist() for c in ("dim", "slab", "block", "part", "is_query", "vec_id", "bound")), strict=True):
                if now != key:
                    key, lines, ids, vectors = now, None, [], []
                vector = flat[at : at + now[0]]
                at += now[0]
                if not is_query:
                    ids.append(vec_id)
                    vectors.append(vector.copy())
                elif ids:
                    lines = lines or Lines.build(np.array(ids, np.int64), np.array(vectors))
                    place, distance, verified = lines.nearest(vector, vec_id, k, math.inf if bound is None else bound)
                    out.append((vec_id, None, None, verified))
                    out.extend((vec_id, int(lines.ids[p]), float(d), 0) for p, d in zip(place, distance, strict=True))
            yield found()

    return search


def usable(vector: Column) -> Column:
    """Neither null, nor zero, nor holding a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def slabs_of(rows: DataFrame, block: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length the direction along which a sample is widest, and the edges between slabs of about a block."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT).select("dim", "embedding").toArrow()
    dims, plan = np.array(sample.column("dim").to_pylist(), np.int64), {}
    sizes = {r.dim: r["count"] for r in rows.where(F.col("dim").isin(np.unique(dims).tolist())).groupBy("dim").count().collect()} if len(dims) else {}
    vectors = sample.column("embedding").to_pylist()
    for dim, n in sizes.items():
        some = np.array([vectors[i] for i in np.flatnonzero(dims == dim)], float)
        slabs = min(SLABS, -(-n // block), len(some))
        if slabs > 1:
            along = np.linalg.svd(some - some.mean(0), full_matrices=False)[2][0]
            plan[dim] = along, np.quantile(some @ along, np.arange(1, slabs) / slabs)
    return plan


def neighbours(vectors: DataFrame, work: Workspace, k: int = K, every: int = EVERY, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose vec_id every divides, by Euclidean distance;
    and verified, how many exact distances the query took.

    All other rows are candidates; rows with the query's own id are not. Unusable vectors (null, zero, with null or
    non-finite components) and rows without id take no part; vectors of another length are not compared. A vec_id names one
    vector: of rows that repeat it, that with the smallest components counts. Fewer candidates give fewer rows, an empty
    table none. Equal vectors are all verified, so ties go to the smaller ids however many there are. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = work.write(rows.withColumn("dim", F.size("embedding").cast("long")), "vectors")
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = work.write(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding").cast("long")), "distinct")
    plan = slabs_of(rows, block)
    placed = work.write(rows.select("dim", "vec_id", "embedding").mapInArrow(placer(plan), "dim long, vec_id long, embedding array<double>, along double, slab int"), "placed")
    # a row for each slab: SLABS at most for each vector length
    cells = placed.groupBy("dim", "slab").agg(
        F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("along").alias("from"), F.max("along").alias("to"))
    cells = work.write(cells, "cells")
    asked = placed.where(F.col("vec_id") % every == 0)

    def search(met: DataFrame) -> DataFrame:
        """met: the queries (dim, slab, vec_id, embedding, bound), once for each slab that they visit."""
        parts = met.groupBy("dim", "slab").agg(F.ceil(F.count("*") / queries).cast("int").alias("parts")).join(cells, ["dim", "slab"])
        parts = small(work.write(parts, "parts"))
        number = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        out = ["is_query", "vec_id", "bound", "embedding"]
        held = placed.join(parts, ["dim", "slab"]).select("dim", "slab", number(0, "blocks").alias("block"), each("parts").alias("part"), F.lit(False).alias("is_query"), "vec_id", F.lit(None).cast("double").alias("bound"), "embedding")
        met = met.join(parts, ["dim", "slab"]).select("dim", "slab", each("blocks").alias("block"), number(1, "parts").alias("part"), F.lit(True).alias("is_query"), "vec_id", "bound", "embedding")
        dealt = held.unionAll(met).repartition("dim", "slab", "block", "part").sortWithinPartitions("dim", "slab", "block", "part", "is_query", "vec_id")
        return dealt.select("dim", "slab", "block", "part", *out).mapInArrow(searcher(k), FOUND)

    by = Window.partitionBy("query_id")
    best = by.orderBy(F.col("vec_id").isNull(), "score", "vec_id")
    found = search(asked.select("dim", "slab", "vec_id", "embedding", F.lit(None).cast("double").alias("bound")))
    if plan:
        home = work.write(found, "home")
        bounds = home.where("vec_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
        # one row more than the distance's rounding, since the slabs' ends are sums in another order
        reach = F.coalesce(F.col("bound"), F.lit(math.inf)) + 1e-9
        away = asked.withColumnRenamed("slab", "at").join(bounds, "vec_id", "left").join(small(cells), "dim")
        away = away.where((F.col("slab") != F.col("at")) & (F.col("along") - reach <= F.col("to")) & (F.col("along") + reach >= F.col("from")))
        found = home.unionAll(search(work.write(away.select("dim", "slab", "vec_id", "embedding", "bound"), "away")))
    ranked = found.select("*", F.row_number().over(best).alias("rank"), F.sum("verified").over(by).alias("all_verified"))
    ranked = ranked.where((F.col("rank") <= k) & F.col("vec_id").isNotNull())
    return ranked.select("query_id", "rank", "vec_id", "score", F.col("all_verified").alias("verified"))


def small(cells: DataFrame) -> DataFrame:
    """cells, to be broadcast if they are few, as they are but for very many different vector lengths."""
    return F.broadcast(cells) if cells.count() <= 100_000 else cells


def op6_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), Workspace(spark))
