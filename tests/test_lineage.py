"""Ancestors of layers, and redirects to their end."""

import random

import pytest

from mailstruct.operators import lineage
from mailstruct.plans.scratch import Scratch

LAYERS = "email_id long, layer_seq int, parent_layer_seq int, path string"


def layers(spark, rows):
    return spark.createDataFrame([(e, s, p, "x") for e, s, p in rows], LAYERS)


def test_ancestors_equal_brute_force(spark):
    rng, rows = random.Random(1), []
    for e in range(6):
        rows += [(e, s, rng.choice([None, *range(s)]) if s else None) for s in range(rng.randint(1, 30))]
    rows += [(7, 0, None), (7, 1, 1), (7, 2, 5), (7, 3, 2), (8, 4, 3)]  # no parents of their own: itself, a later layer, one that isn't there
    above = {(e, s): p for e, s, p in rows if p is not None and p < s}
    want, paths = [], []
    for e, s, _ in rows:
        path = [s]
        while (e, path[-1]) in above:
            path.append(above[e, path[-1]])
            want.append((e, s, path[-1], len(path) - 1, list(path)))
        paths.append((e, s, path[-1], len(path) - 1, path[::-1]))
    frame = layers(spark, rows)
    assert sorted(map(tuple, lineage.ancestry(frame).collect())) == sorted(want)
    assert sorted(map(tuple, lineage.whole_paths(frame).collect())) == sorted(paths)


def test_deep_and_empty_tables(spark):
    chain = layers(spark, [(1, s, s - 1 if s else None) for s in range(150)])
    assert lineage.ancestry(chain).count() == 150 * 149 // 2
    assert lineage.ancestry(layers(spark, [])).count() == lineage.whole_paths(layers(spark, [])).count() == 0


def follow(known, url, most):
    path = [url]
    while path[-1] in known:
        if known[path[-1]] in path:
            return None, None, "loop"
        path.append(known[path[-1]])
    return path[-1], len(path) - 1, "ok" if len(path) - 1 <= most else "too_many"


@pytest.mark.parametrize("seed", range(3))
def test_redirects_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"u{i}", f"u{rng.randint(0, 60)}") for i in range(50)]
    rows += [("a", "a"), ("b", None), (None, "c"), ("u1", "u0"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("into", "c2")] + [(f"l{i}", f"l{i + 1}") for i in range(40)]
    known = {}
    for s, t in rows:
        if s is not None and t is not None and s != t:
            known[s] = min(t, known.get(s, t))
    got = {r.short: (r.final, r.hops, r.status) for r in lineage.redirects(spark.createDataFrame(rows, "short string, long string"), Scratch(spark), 7).collect()}
    assert got == {s: follow(known, s, 7) for s in known}


def test_only_shortened_links_are_looked_up(spark):
    urls = spark.createDataFrame([("a", True), ("a", False), ("x", True), ("o", True), (None, True)], "original_url string, is_shortened boolean")
    known = spark.createDataFrame([("a", "b"), ("b", "c"), ("o", "p"), ("p", "o")], "short string, long string")
    got = lineage.expand_to_end(urls, known, Scratch(spark)).collect()
    assert sorted((r.original_url or "-", r.is_shortened, r.expanded_url, r.hops, r.redirect_status or "-") for r in got) == [
        ("-", True, "Not Applicable", None, "-"), ("a", False, "Not Applicable", None, "-"), ("a", True, "c", 2, "ok"), ("o", True, "Not Applicable", None, "loop"), ("x", True, "Not Applicable", None, "-"),
    ]
    none = spark.createDataFrame([], "short string, long string")
    assert lineage.redirects(none, Scratch(spark)).count() == 0
