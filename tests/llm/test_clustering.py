"""Centroid clustering: the screen never loses the nearest, and clusters equal plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from mailstruct.llm import clustering
from mailstruct.llm.common import Workspace

ROWS = "vec_id long, embedding array<double>, label int, cluster int, distance long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, None, 7, None, "x") for i, e in rows], ROWS)


def brute(rows, dim, scale, k, rounds, seed=1):
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) and abs(x * scale) < clustering.LIMIT for x in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        number = [best(v) for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), n in zip(kept, number, strict=True) if n == j]
            if mine:
                centroids[j] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    number = [best(v) for _, v in kept]
    distance = [far(v, centroids[n]) for (_, v), n in zip(kept, number, strict=True)]
    inertia = {j: sum(d for d, n in zip(distance, number, strict=True) if n == j) for j in set(number)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(distance), digest[n]) for (i, _), n, d in zip(kept, number, distance, strict=True)]


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_the_screen_keeps_the_nearest_even_where_float32_can_t_tell():
    random = np.random.default_rng(3)
    for size in (4, 1 << 12, 1 << 24, 1 << 26):
        x = random.integers(-size, size, (400, 64))
        centroids = x[:20] + random.integers(-1, 2, (20, 64))
        centroids[7] = centroids[3]
        want = ((x[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
        got, exact = clustering.nearest(x, centroids)
        assert (got == want).all() and clustering.shortlist(x, centroids)[np.arange(400), want].all()
        assert exact < 400 or size == 4
    # far away from 0, where all float32 distances are equal
    x = (1 << 26) + random.integers(0, 3, (300, 64))
    got, exact = clustering.nearest(x, x[:30])
    assert (got == ((x[:, None] - x[None, :30]) ** 2).sum(2).argmin(1)).all() and exact > 200


def test_most_vectors_need_no_exact_distances():
    x = np.floor(np.random.default_rng(1).standard_normal((5000, 64)) * 8).astype(np.int64)
    assert clustering.nearest(x, x[:16])[1] < 100


@pytest.mark.parametrize(("dim", "k", "rounds"), [(3, 4, 3), (64, 16, 3), (2, 40, 5)])
def test_clusters_equal_brute_force(spark, dim, k, rounds):
    random = np.random.default_rng(dim)
    rows = [(int(i), random.normal(0, 1, dim).round(2).tolist()) for i in random.permutation(90)]
    got = clustering.cluster(frame(spark, rows).repartition(5), Workspace(spark), dim, 64, k, rounds).collect()
    assert order(got) == order(brute(rows, dim, 64, k, rounds))


def test_odd_vectors(spark):
    """Nulls, other lengths, non-finite and huge components take no part; zeros, ties, repeats and null ids do."""
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, math.nan]), (6, [math.inf, 0.0]), (7, [1e30, 0.0]), (8, [0.0, 0.0]), (9, [-0.001, 0.02])]
    rows += [(10, [1.0, 1.0])] * 3 + [(None, [2.0, -2.0]), (None, [2.5, -2.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0]), (12, [5.0, 1.0])]
    for k in (1, 2, 5, 30):
        got = clustering.cluster(frame(spark, rows), Workspace(spark), 2, 64, k, 3).collect()
        assert order(got) == order(brute(rows, 2, 64, k, 3)) and len(got) == 10


def test_no_vectors(spark):
    for rows in ([], [(1, None)], [(2, [1.0])]):
        got = clustering.cluster(frame(spark, rows), Workspace(spark), 2)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0
