"""Centroid clustering of integer vectors: fast float32 products screen, exact integers decide.

A matrix product in float32 gives each vector's squared distance to every centroid but for a rounding error that is bounded
whatever the order of summation. Centroids whose interval reaches below the smallest upper end stay; where more than one does, their
distances are worked out anew in 64-bit integers, and the smallest number wins among equals. Every assignment is therefore that of
exact arithmetic. A round moves no vector: tasks send sums for each centroid and dimension, which are added up exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstruct.llm.common import Workspace, table

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components of this size or more could push a squared distance out of 64 bits.
LIMIT = 1 << 27
#: Half the distance from 1 to the next float32, and scores of a block.
UNIT, BLOCK = 2.0**-24, 1 << 20
LONG = (1 << 63) - 1


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components times scale rounded down, of the vectors that take part (see cluster)."""
    given = F.col("embedding").cast("array<double>")
    sound = (F.size(given) == dim) & F.forall(given, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) * scale < LIMIT), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, F.transform(given, lambda x: F.floor(x * scale))).alias("v")).where("v is not null")


def draw(vec_id: Column, seed: int = SEED) -> Column:
    """Lowercase hex sha256 of `seed:vec_id`; null for null."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), vec_id.cast("string")).cast("binary"), 256)


def shortlist(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids can be the nearest of each vector: never leaves out one that is.

    A float32 sum of n products, each of two rounded factors, is off by at most g times the sum of their sizes, where
    g = m u / (1 - m u), m = n + 2 and u is UNIT, in any order and with or without fused steps; that sum is at most the product of
    the norms. The last term bounds what the double operations around it round away.
    """
    squares, m = (centroids**2).sum(1).astype(np.float64), x.shape[1] + 2
    norms = np.sqrt((x**2).sum(1).astype(np.float64))[:, None] * np.sqrt(squares) * (1 + 1e-12)
    about = squares - 2.0 * (x.astype(np.float32) @ centroids.astype(np.float32).T)
    error = 2 * (m * UNIT / (1 - m * UNIT)) * norms + 2.0**-50 * (squares + 2 * norms)
    return about - error <= (about + error).min(1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each vector's nearest centroid, the smallest among equals, and how many vectors' exact distances decided."""
    among = shortlist(x, centroids)
    number, open_rows = among.argmax(1), np.flatnonzero(among.sum(1) > 1)
    row, column = np.nonzero(among[open_rows])
    distance = ((x[open_rows[row]] - centroids[column]) ** 2).sum(1)
    order = np.lexsort((column, distance, row))
    first = np.unique(row[order], return_index=True)[1]
    number[open_rows] = column[order][first]
    return number, len(open_rows)


def blocks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, vectors and nearest centroids, a bounded number of rows at a time."""
    rows = max(1, BLOCK // len(centroids))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            x = some.column("v").flatten().to_numpy().reshape(some.num_rows, -1)
            yield some.column("vec_id"), x, nearest(x, centroids)[0]


def summing(centroids: np.ndarray):
    """Rows (cluster, place, total): the sums of a task's vectors for each of its clusters and dimensions; place -1 counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
        for _, x, number in blocks(batches, centroids):
            order = np.argsort(number, kind="stable")
            met, first = np.unique(number[order], return_index=True)
            sums[met, 1:] += np.add.reduceat(x[order], first, axis=0)
            sums[met, 0] += np.diff(np.append(first, len(order)))
        met = np.flatnonzero(sums[:, 0])
        places = np.arange(-1, centroids.shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(met, len(places)).astype(np.int32)), pa.array(np.tile(places, len(met)).astype(np.int32)), pa.array(sums[met].ravel())], ["cluster", "place", "total"]
        )

    return run


def assigning(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, number in blocks(batches, centroids):
            distance = ((x - centroids[number]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. The driver holds a row for each centroid and dimension."""
    sums = rows.mapInArrow(summing(centroids), "cluster int, place int, total long")
    sums = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total")).collect()
    found = {(r.cluster, r.place): int(r.total) for r in sums}
    out = centroids.copy()
    for i in {cluster for cluster, _ in found}:
        out[i] = [found[i, place] // found[i, -1] for place in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, work: Workspace, dim: int = DIM, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part.

    Left out are vectors that are null, of another length, or hold a component that is null or not finite, or whose product with scale
    is LIMIT or more in size, since squared distances could leave 64 bits. Repeated rows count as often as they occur; among equal ids the
    smaller vector starts first, and a null id starts after all others. Fewer vectors than k make fewer centroids; an
    empty table gives an empty result. Other columns are not read. An inertia beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    rows = work.write(integers(vectors, dim, scale), "vectors")
    starts = rows.orderBy(draw(F.col("vec_id"), seed).asc_nulls_last(), "v").limit(k).collect()
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return rows.select("vec_id").join(spark.createDataFrame([], schema).withColumn("distance", F.lit(0).cast("long")), F.lit(False)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    centroids = np.array([r.v for r in starts], np.int64)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    assigned = work.write(rows.mapInArrow(assigning(centroids), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("total")).collect()}
    whole = lambda n: n if n <= LONG else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    # a row for each centroid
    known = spark.createDataFrame([(i, whole(n), whole(sum(sums.values())), digest(centroids[i])) for i, n in sorted(sums.items())], schema)
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), Workspace(spark))


def oracle(dim: int = DIM, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in SQL: all distances in plain integers, round after round."""
    whole = f"vectors AS (SELECT row_number() OVER () AS row, vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"
    parts = [
        whole,
        "cells AS (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM vectors)",
        f"starts AS (SELECT row, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS number FROM vectors QUALIFY number < {k})",
        "c0 AS (SELECT number, place, x FROM starts JOIN cells USING (row))",
    ]
    for i in range(rounds + 1):
        parts += [
            f"d{i} AS (SELECT row, number, sum((cells.x - c{i}.x) * (cells.x - c{i}.x))::BIGINT AS distance FROM cells JOIN c{i} USING (place) GROUP BY ALL)",
            f"a{i} AS (SELECT row, number, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, number) = 1)",
            f"m{i} AS (SELECT number, place, sum(x) AS s, count(*) AS n FROM cells JOIN a{i} USING (row) GROUP BY ALL)",
            f"c{i + 1} AS (SELECT number, place, CASE WHEN n IS NULL THEN x ELSE ((s - ((s % n + n) % n)) // n)::BIGINT END AS x FROM c{i} LEFT JOIN m{i} USING (number, place))",
        ]
    return f"""WITH {", ".join(parts)},
        digests AS (SELECT number, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY number)
        SELECT vec_id, number::INT AS cluster, distance, sum(distance) OVER (PARTITION BY number)::BIGINT AS cluster_inertia,
            sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN vectors USING (row) JOIN digests USING (number)"""


ORACLE = oracle()
