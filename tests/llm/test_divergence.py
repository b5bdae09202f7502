"""Source divergence: every term, pair and group by brute force, and odd rows."""

import re
from collections import Counter, defaultdict

import pytest

from mailstruct.llm import divergence
from mailstruct.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n long, term string, value int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 9, "x", None) for i, (t, g, s) in enumerate(rows)], DOCS)


def brute(rows, least, top):
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(fold)), g, s) for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        mine = [(w, s) for w, g, s in words if g == lang]
        docs = Counter(w for ws, _ in mine for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= least)
        counts = defaultdict(Counter)
        for ws, s in mine:
            counts[s].update(w for w in ws if docs[w] >= least)
        total = Counter()
        for c in counts.values():
            total.update(c)
        def p_of(c):
            return {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: B023
        p, q = {s: p_of(counts[s]) for s in {s for _, s in mine}}, p_of(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pair = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in p if o != s]
            term = [(w, f(p[s][w], q[w])) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pair), ("term", term)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def check(spark, rows, least=2, top=3):
    got = divergence.audit(frame(spark, rows).repartition(3), Workspace(spark), least, top).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, top)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    import numpy as np

    random = np.random.default_rng(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Éa", "日本", "zß"]
    rows = [(" ".join(random.choice(words, random.integers(0, 30), p=None)), f"l{random.integers(2)}", f"s{random.integers(5)}") for _ in range(80)]
    assert len(check(spark, rows)) > 30


def test_odd_rows(spark):
    """Nulls, groups without terms, repeats, ties, other alphabets, digits and marks, a very long text, a lone source."""
    rows = [(None, None, None), (None, "en", "a"), ("", "en", "b"), ("the The tHE x1y z_z\x00q", "en", "a"), ("the x y z q", "en", "c"), ("12 34 !!", "en", "d")]
    rows += [("İI ǅ K Å á ̀b", "en", "c")] * 2 + [("one two", "xx", "s")] * 3 + [("lone", "yy", "s")] + [("alike" * 3 + " b" * 20_000, "en", "e"), ("b ퟿😀 😀", "en", "d"), ("😀 b", "", "")]
    check(spark, rows)
    check(spark, rows, least=100)
    check(spark, rows, top=1)


def test_no_rows(spark):
    got = divergence.audit(frame(spark, []), Workspace(spark))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0


def test_sums_of_a_task_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    rows = [("en", "a", b"x y x"), ("en", "a", b"x"), ("en", "b", b"z z z z"), ("de", "a", b"")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "source", "text"])
    out = list(divergence.counted(iter([batch])))
    total = Counter()
    for b in out:
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    assert len(out) == 3 and total == {("en", "a", "x"): 3, ("en", "a", "y"): 1, ("en", "b", "z"): 4}


def test_a_task_hands_on_each_term_of_millions_of_words_once():
    import numpy as np
    import pyarrow as pa

    random = np.random.default_rng(1)
    words = np.array([f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(17_000)])
    rows = [(f"l{i % 2}", f"s{i % 5}", (" 1".join(random.choice(words, random.integers(0, 6000))) + "é ÉA,").encode()) for i in range(500)] + [("l0", "none", b" ")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "source", "text"])
    got = [((r["lang"], r["source"], r["term"]), (r["n"], r["docs"])) for b in divergence.counted(iter([batch.slice(0, 200), batch.slice(200)])) for r in b.to_pylist()]
    n, docs = Counter(), Counter()
    for lang, source, text in rows:
        found = text.translate(divergence.FOLD).decode().split()
        n.update((lang, source, w) for w in found)
        docs.update((lang, source, w) for w in set(found))
    assert n.total() > 1_000_000 and len(got) == len(n) and dict(got) == {k: (n[k], docs[k]) for k in n}


def test_shares_are_exact_in_and_beyond_64_bits(spark):
    counts = [(0, 7), (divergence.NARROW - 1, 10**10), (divergence.NARROW, 10**10), (4 * 10**12, 9 * 10**12)]
    got = spark.createDataFrame(counts, "n long, size long").select("n", "size", divergence.share("n", "size").cast("string").alias("p")).collect()
    assert [int(r.p) for r in got] == [1 + 10**9 * (r.n + 2) // r.size for r in got]
