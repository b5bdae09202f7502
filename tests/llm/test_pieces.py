"""Piece encoding: the library's ids on real and random texts, and plain merging on random vocabularies."""

import hashlib
import random
from array import array

import ahocorasick
import pytest
from conftest import DATA

from mailstruct.llm import pieces
from mailstruct.llm.common import table

DOCS = "doc_id long, text string, lang string, ids string, n_tokens string, decoded int"
LETTERS = "abcdetheinANDing 0123456789 ▁  \n\t.,<>|/é日本😀\x00ß²½_{}"
ODD = ["", " ", "  ", "▁", " ▁ x", "a", "<s></s><unk><0x41>", "\x00\x01", "日本語😀x", "the", " the  end ", "²." * 40, "É" * 300, "1234 5_6{7}", "x" * 9000, "ab" * 9000, "\n\n\n", "a\r\nb"]
ODD += [" " * k for k in range(40)] + ["x" + " " * k + "the" for k in range(40)]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces()


@pytest.mark.parametrize("window", [4096, 8])
def test_ids_are_the_library_s(model, monkeypatch, window):
    monkeypatch.setattr(pieces, "WINDOW", window)
    rng = random.Random(window)
    texts = ODD + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 90))) for _ in range(3000)]
    assert [model.encode(t) for t in texts] == model.library.encode(texts)
    for t in texts:  # without cuts into chunks
        if t:
            assert array("I", model.encode_chunk("▁" + t.replace(" ", "▁"))).tolist() == model.library.encode(t)


def test_forgetting_keeps_the_ids(model, monkeypatch):
    monkeypatch.setattr(model.known, "half", 20)
    monkeypatch.setattr(model.goes, "half", 20)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("aeinrst") for _ in range(6)) for _ in range(100)) for _ in range(20)]
    assert [model.encode(t) for t in texts] == model.library.encode(texts)
    assert len(model.known) <= 20 + 100


def merged(string, scores):
    parts = list(string)
    while True:
        found = [scores.get(a + b, -1e99) for a, b in zip(parts, parts[1:], strict=False)]
        if not found or max(found) == -1e99:
            return parts
        at = found.index(max(found))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_random_vocabularies_equal_plain_merging(monkeypatch):
    """Scores in any order and with ties, pieces that merging never makes, unknown characters, and windows shorter than the string."""
    gave_back = 0
    for trial in range(200):
        rng = random.Random(trial)
        monkeypatch.setattr(pieces, "WINDOW", rng.choice([4, 4096]))
        known = set("abc")
        for _ in range(rng.randint(3, 25)):
            both = rng.choice(sorted(known)) + rng.choice(sorted(known))
            known |= {both} if len(both) < 9 else set()
        known -= {"c"} if rng.random() < 0.3 else set()
        it = pieces.Pieces.__new__(pieces.Pieces)
        it.ids = {p: i for i, p in enumerate(sorted(known))}
        it.scores = {p: float(rng.randint(-7, -1)) for p in it.ids}
        it.longest = max(map(len, known))
        it.histories = {p: h for p in it.ids if (h := it.history(p))}
        it.automaton = ahocorasick.Automaton()
        for p in it.histories:
            it.automaton.add_word(p, len(p))
        it.automaton.make_automaton()
        it.goes = pieces.Memory(it.go_together, 50)
        for _ in range(40):
            string = "".join(rng.choice("abcd" if rng.random() < 0.1 else "ab") for _ in range(rng.randint(1, 40)))
            got = it.split(string)
            assert got == merged(string, it.scores)
            greedy = it.matches(string, 0)[0] if len(string) <= 4 else len(got[0])
            gave_back += greedy != len(got[0])
    assert gave_back


def test_other_vocabularies_are_refused():
    with pytest.raises(Exception, match="."):
        pieces.Pieces("word_bpe_49k.json")


def test_whole_texts_and_odd_rows(spark, model):
    """Null and empty texts, null ids, repeated rows, very long texts and clashing columns."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, "twice"), (5, "twice"), (6, None), (7, "long wörds " * 20_000)]
    docs = spark.createDataFrame([(i, t, None, "x", "y", 3) for i, t in rows], DOCS).repartition(4)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = model.library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(model.library.decode(ids))))
    assert sorted(map(repr, map(tuple, pieces.digests(docs).collect()))) == sorted(map(repr, want))
    whole = pieces.encode_documents(docs).collect()
    assert sorted((r.n_tokens, r.ids, r.decoded) for r in whole) == sorted((len(x), x, model.library.decode(x)) for x in (model.library.encode(t or "") for _, t in rows))
    none = spark.createDataFrame([], DOCS)
    assert pieces.digests(none).count() == 0 and pieces.encode_documents(none).count() == 0


def test_the_query_equals_the_library(spark, model):
    docs = table(spark, DATA, "documents").collect()
    want = {(r.doc_id, hashlib.sha256(",".join(map(str, model.library.encode(r.text or ""))).encode()).hexdigest()) for r in docs}
    got = pieces.op12_piece_encoding(spark, DATA).collect()
    assert {(r.doc_id, r.ids_sha256) for r in got} == want and len(got) == len(docs)
