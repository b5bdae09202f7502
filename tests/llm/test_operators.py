"""The training-data operators: exact round trips, brute force and held-out accuracy on small tables, and the odd cases."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from mailstruct.llm import mixing, near_duplicates, nearest, packing, rules, sharding, token_cache, tokens, toxicity, transport_stream, warc_bundles
from mailstruct.llm.common import Workspace, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, bands string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


#: Null and empty texts, a null id, repeated rows, equal texts, a very long text, odd separators, and clashing column names.
ODD = [
    (1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, prose(5, 60)), (5, prose(5, 60)), (6, prose(5, 60)), (7, prose(7, 20_000)),
    (8, "a\x1cb c\x85d <|endoftext|> it's É ñ!!"), (9, prose(5, 60) + " tail"), (10, prose(10, 80)), (11, "\x00\x01"), (None, "no id here"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 4 else "en", None if i in (2, 9) else f"s{(i or 0) % 3}", None, "x", "y", "z") for i, t in ODD]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def work(spark):
    return Workspace(spark)


def texts():
    return [(i, t or "") for i, t in ODD]


def test_banding_reaches_its_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.95), (0.95, 0.99)):
        bands, rows = near_duplicates.choose_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= near_duplicates.HASHES
    with pytest.raises(ValueError, match="no banding"):
        near_duplicates.choose_bands(0.01, 0.9999, 8)


def test_ids_are_the_library_s():
    words = [t for _, t in texts()] + ["ΑΣ ς İ ǅ", "日本語 x", "don'T 'S", "Å Ω ² ½ ª", "ab cd"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        encode = tokens.Encoder(name)
        want = encode.whole(words)
        flat, at = encode.ids(pa.array(words))
        assert [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] == want
        assert encode.counts(pa.array(words)).tolist() == [len(w) // 4 for w in want]


def test_counts_make_no_object_of_a_chunk():
    """Chunks of one word with many marks about it cost their pieces alone; the counts are the library's."""
    encode = tokens.Encoder("word_bpe_49k.json")
    words = [" ".join(f"{a}word{b}" for a in "([{<*" for b in [".", "!?", "'s", "'S", "9²", ">|", "<|x", "\x1e", "É,", "日"]), "", "  ", "it's. ªº µß<|endoftext|>"]
    assert encode.counts(pa.array(words)).tolist() == [len(w) // 4 for w in encode.whole(words)]
    assert all(not encode.safe.fullmatch(w) or "<|" in w for w in encode.chunks) and "word" in encode.cores


def test_ids_make_objects_of_pieces_only():
    encode = tokens.Encoder("word_bpe_49k.json")
    words = ["word, don't É1'sé ½ x", "", " ñ!! <|endoftext|>a 日本 word,", "ª²µ -- ..a..b"]
    flat, at = encode.ids(pa.array(words))
    assert [flat[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] == encode.whole(words)
    assert set(encode.chunks) == {"<|endoftext|>a", "日本"} and "word" in encode.cores


def test_forgetting_words_keeps_the_ids(monkeypatch):
    encode = tokens.Encoder("word_bpe_49k.json")
    want = [encode.ids(pa.array([prose(i, 300)]))[0].tobytes() for i in range(4)]
    monkeypatch.setattr(tokens, "REMEMBER", 50)
    assert [encode.ids(pa.array([prose(i, 300)]))[0].tobytes() for i in range(4)] == want


# --- 1: transport streams


def test_streams_round_trip():
    for n in (0, 1, 64, 150, 158, 161, 162, 163, 164, 346, 347, 348, 32767, 32768, 32769, 200_000):
        data = np.random.default_rng(n).bytes(n)
        media = transport_stream.store(data)
        got = transport_stream.parse(media)
        assert got.payload() == data and len(media) % 188 == 0
        assert (got.continuity_errors, got.duplicates, got.table_errors, got.skipped_bytes) == (0, 0, 0, 0)
        assert [u[1] for u in got.units] == [i * transport_stream.TICKS for i in range(-(-n // transport_stream.UNIT))]
        assert all(u[3] for u in got.units)


def test_damage_is_counted():
    data = np.random.default_rng(1).bytes(5000)
    media = transport_stream.store(data)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    lost = transport_stream.parse(b"".join(packets[:5] + packets[6:]))
    assert lost.continuity_errors == 1
    twice = transport_stream.parse(b"".join(packets[:5] + packets[4:]))
    assert twice.duplicates == 1 and twice.payload() == data
    shifted = transport_stream.parse(b"xyz" + media)
    assert shifted.payload() == data and shifted.skipped_bytes == 3
    broken = bytearray(media)
    broken[10] ^= 1
    assert transport_stream.parse(bytes(broken)).table_errors == 1
    rng = np.random.default_rng(2)
    for _ in range(100):
        noise = bytearray(media)
        for _ in range(30):
            noise[rng.integers(len(noise))] = rng.integers(256)
        transport_stream.parse(bytes(noise)).feature()
        transport_stream.parse(rng.bytes(rng.integers(2000))).feature()


def test_op1(spark):
    rows = {r.doc_id: r for r in transport_stream.op1_transport_stream(spark, DATA).collect()}
    docs = table(spark, DATA, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        payload, got = transport_stream.padded(raw), rows[d.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = transport_stream.store(payload)
        assert (got.media_bytes, got.media_sha256, got.feature) == (len(media), hashlib.sha256(media).hexdigest(), transport_stream.parse(media).feature())


def test_streams_of_odd_rows(spark, odd, empty, tmp_path):
    for rows, want in ((odd, texts()), (empty, [])):
        path = str(tmp_path / f"t{len(want)}" / "documents.parquet")
        rows.withColumn("media", F.lit("m")).withColumn("payload", F.lit(1)).withColumn("feature", F.lit("f")).write.parquet(path)
        got = transport_stream.op1_transport_stream(spark, path.rsplit("/", 1)[0]).collect()
        assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in got) == Counter((i, len(t.encode()), hashlib.sha256(transport_stream.padded(t.encode())).hexdigest()) for i, t in want)
    # in the operator's own interface the new columns replace those of the same names
    again = transport_stream.read_column(transport_stream.store_column(odd.select("doc_id", F.encode("text", "UTF-8").alias("payload"), F.lit(1).alias("media"), F.lit(2).alias("feature")).where("payload is not null")))
    assert len(set(again.columns)) == len(again.columns) and again.count() == len([t for _, t in ODD if t is not None])


# --- 2: packing


def check_packing(docs, pieces):
    encode = tokens.Encoder("word_bpe_49k.json")
    own = {}
    for p in pieces:
        own.setdefault((p.doc_id, p.doc_row), []).append(p)
    assert Counter(k[0] for k in own) == Counter(i for i, _ in docs)
    by_id = {}
    for i, t in docs:
        by_id.setdefault(i, []).append(np.append(np.frombuffer(encode.whole([t])[0], "<u4"), 1).astype("<u4"))
    for (i, _), parts in own.items():
        parts.sort(key=lambda p: p.start)
        for ids in by_id[i]:
            at = 0
            for p in parts:
                if p.start != at or p.doc_tokens != len(ids) or zlib.crc32(ids[at : at + p.length].tobytes()) != p.ids_crc32:
                    break
                at += p.length
            if at == len(ids):
                break
        else:
            raise AssertionError(i)
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    for parts in windows.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark, odd, empty):
    check_packing(texts(), packing.pack_documents(odd).collect())
    docs = [(d.doc_id, d.text or "") for d in table(spark, DATA, "documents").collect()]
    pieces = packing.op2_hierarchical_packing(spark, DATA).collect()
    check_packing(docs, pieces)
    steps = Counter()
    for p in pieces:
        steps[p.step_id] += p.length
    assert max(steps.values()) <= packing.STEP
    assert packing.pack_documents(empty).collect() == []


def test_windows_are_full_while_documents_last():
    rng, pool = np.random.default_rng(3), packing.Packer()
    windows = []
    for i in range(500):
        windows += pool.add((i, 0, i), np.arange(rng.integers(1, 5000)))
    windows += list(pool.drain())
    assert all(sum(len(p.ids) for p in w) in packing.TIERS for w in windows)
    assert sum(n * len(q) for n, q in pool.pool.items()) < 2048


# --- 3: sharding


def check_shards(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_sharding(spark, odd, empty, work):
    docs = {d.doc_id: (d.text or "").encode() for d in table(spark, DATA, "documents").collect()}
    rows = sharding.op3_kd_tree(spark, DATA).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t) + 8, zlib.crc32(t)) for i, t in docs.items()}
    check_shards(rows, 24)
    weight = Counter()
    for r in rows:
        weight[r.shard] += r.size
    mean = sum(weight.values()) / 24
    largest = max(r.size for r in rows)
    assert max(weight.values()) <= mean + largest and min(weight.values()) >= mean - largest
    got = sharding.shard_by_tree(odd, work, 3).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
    check_shards(got, 3)
    assert sharding.shard_by_tree(empty, work, 3).collect() == []


def test_tree_against_brute_force(spark, work):
    # every split of a tree grown in memory by sorting whole keys: the same side of the same dimension, as near the goal as bins allow
    docs = table(spark, DATA, "documents")
    shards, rows = 8, [(d.doc_id, len((d.text or "").encode()) + 8, d.text or "", d.lang, d.source) for d in docs.collect()]
    got = {r.doc_id: r.shard for r in sharding.shard_by_tree(docs, work, shards).collect()}
    weight = Counter()
    for i, size, *_ in rows:
        weight[got[i]] += size
    by_text = {}
    for r in rows:
        by_text.setdefault(r[2], []).append(r)
    points = []
    ranks = [{v: k for k, v in enumerate(sorted({min((x[c] for x in g if x[c] is not None), default="") for g in by_text.values()}))} for c in (3, 4)]
    for g in by_text.values():
        lang, source = (ranks[k][min((x[c] for x in g if x[c] is not None), default="")] for k, c in enumerate((3, 4)))
        points.append(([np.log2(g[0][1]), lang, source, min(x[0] for x in g)], sum(x[1] for x in g), got[g[0][0]]))
    x, w, home = np.array([p[0] for p in points], float), np.array([p[1] for p in points]), np.array([p[2] for p in points])
    x = (x - x.min(0)) / np.maximum(x.max(0) - x.min(0), 1e-9)

    def check(some, first, n):
        if n == 1:
            return
        inside = some[(home[some] >= first) & (home[some] < first + n)]
        assert len(inside) == len(some)
        spread = x[some].max(0) - x[some].min(0)
        left = home[some] < first + n // 2
        # some dimension of nearly the greatest width tells the sides apart, but for ties
        wide = [d for d in range(4) if spread[d] >= spread.max() - 1e-4]
        assert any(x[some[left], d].max() <= x[some[~left], d].min() + 2**-17 for d in wide)
        goal = w[some].sum() * (n // 2) / n
        assert abs(w[some[left]].sum() - goal) <= w[some].max()
        check(some[left], first, n // 2)
        check(some[~left], first + n // 2, n - n // 2)

    check(np.arange(len(w)), 0, shards)


def test_many_leaves_and_ids_that_are_no_numbers(spark, work):
    docs = spark.createDataFrame([(f"id{i}", f"text {i} " * (i % 7 + 1), f"l{i % 3}", f"a-long-source-name-{i % 50}", "x", 1) for i in range(4000)], "doc_id string, text string, lang string, source string, first string, w int")
    got = sharding.shard_by_tree(docs, work, 1000).collect()
    check_shards(got, 1000)
    assert len(got) == 4000 and len({r.shard for r in got}) > 950
    by_bytes = sharding.shard_by_tree(docs, work, None, target_bytes=20_000).collect()
    weight = Counter()
    for r in by_bytes:
        weight[r.shard] += r.size
    assert max(weight.values()) <= 21_000


def test_a_hot_text_is_spread_and_others_stay_together(spark, work):
    rows = [(i, "hot text " * 20 if i % 2 else f"{i // 10} " + "x" * 100, "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.shard_by_tree(docs, work, 6).collect()
    weight, homes = Counter(), {}
    for r in got:
        weight[r.shard] += r.size
        homes.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert max(weight.values()) < 1.1 * min(weight.values())
    assert max(len(h) for t, h in homes.items() if not t.startswith("hot")) == 1
    check_shards(got, 6)


# --- 4: token counts


def test_token_cache(spark, odd, empty, work, monkeypatch):
    cache = work.path("cache")
    encode = tokens.Encoder("word_bpe_49k.json")
    want = Counter((i, len(t.encode()), len(encode.whole([t])[0]) // 4) for i, t in texts())
    got = token_cache.count_tokens(odd, cache).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert {r.over_limit for r in got if r.doc_id == 7} == {True}
    first = spark.read.parquet(cache).count()
    assert first == spark.read.parquet(cache).select("digest").distinct().count()
    again = token_cache.count_tokens(odd, cache).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in again) == want and spark.read.parquet(cache).count() == first
    # another tokenizer shares no count
    other = token_cache.count_tokens(odd, cache, "piece_bpe_32k.model").collect()
    piece = tokens.Encoder("piece_bpe_32k.model")
    assert Counter((r.doc_id, r.n_tokens) for r in other) == Counter((i, len(piece.whole([t])[0]) // 4) for i, t in texts())
    assert token_cache.count_tokens(empty, cache).collect() == []


def test_op4_reads_its_cache(spark, work):
    cache, encode = work.path("kept"), tokens.Encoder("word_bpe_49k.json")
    docs = {d.doc_id: d.text or "" for d in table(spark, DATA, "documents").collect()}
    want = {(i, len(t.encode()), len(encode.whole([t])[0]) // 4) for i, t in docs.items()}
    for _ in range(2):
        got = token_cache.op4_digest_cache(spark, DATA, cache).collect()
        assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(docs)
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
        held = spark.read.parquet(cache)
        assert held.count() == held.select("digest").distinct().count()
    # the second run has encoded nothing; rows whose counts are kept are counted from there
    before = held.inputFiles()
    more = table(spark, DATA, "documents").select("doc_id", "text").unionAll(spark.createDataFrame([(-1, "quite new words"), (-2, "quite  new words ")], "doc_id long, text string"))
    got = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(more, cache).collect()}
    assert got[-1] == got[-2] == 3 and spark.read.parquet(cache).count() == held.count() + 1 and set(before) <= set(spark.read.parquet(cache).inputFiles())


def test_fast_ids_only_for_a_file_that_is_known(tmp_path, monkeypatch):
    import json

    source = tokens.tokenizer_path("word_bpe_49k.json")
    assert tokens.drops_space("word_bpe_49k.json") and not tokens.drops_space("byte_bpe_50k.json")
    spec = json.load(open(source))
    for change in ({"normalizer": None}, {"added_tokens": [{"content": "a b", "lstrip": False, "rstrip": False}]}, {"model": spec["model"] | {"end_of_word_suffix": None}}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change))
        monkeypatch.setattr(tokens, "tokenizer_path", lambda name: str(tmp_path / name))
        assert not tokens.drops_space("other.json")


# --- 5: near duplicates


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(docs):
    sets, equal = {i: shingles(t) for i, t in docs}, {i: tuple(t.lower().split()) for i, t in docs}
    ids = sorted(sets)
    root, links = {i: i for i in ids}, Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (equal[a] == equal[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (top(i), links[i]) for i in ids}


def test_near_duplicates_against_brute_force(spark, odd, empty, work):
    docs = [(d.doc_id, d.text or "") for d in table(spark, DATA, "documents").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.op5_jaccard_join(spark, DATA).collect()}
    assert got == brute_classes(docs)
    rows = near_duplicates.near_duplicates(odd, work).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD)
    by = {r.doc_id: r for r in rows}
    assert by[5].class_id == by[6].class_id == by[9].class_id == 5 and by[5].n_copies == 3
    assert by[1].class_id == by[2].class_id == by[3].class_id == 1 and by[4].n_links == 0
    assert near_duplicates.near_duplicates(empty, work).collect() == []


def test_boilerplate_is_not_verified_in_pairs(spark, work):
    # 400 texts that share half of their words meet in many buckets; no pair is near the threshold, and none is verified
    rng = np.random.default_rng(12)
    shared = prose(70, 100)
    rows = [(i, shared + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**9, 48))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = docs.select("doc_id", "text").mapInArrow(near_duplicates.signer(31, 6, pa.int64()), "doc_id long, " + near_duplicates.SIGNED)
    buckets = signed.select(F.explode("bands").alias("b")).groupBy("b").count().where("count > 1").count()
    edges = near_duplicates.candidates_of(signed, work, near_duplicates.least_equal(186)).collect()
    assert buckets >= 20 and len(edges) <= 4
    got = near_duplicates.near_duplicates(docs, work).collect()
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in got)


def test_rows_without_id_and_ids_of_text(spark, work):
    a, b = prose(1, 60), prose(1, 60) + " tail"
    rows = [(None, a), ("x", b), ("w", "else " + prose(3, 30)), (None, b), (None, prose(9, 40)), ("x", prose(9, 40) + " more"), ("x", b)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), work).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter([(None, "x", 3), ("x", "x", 3), ("w", "w", 0), (None, "x", 3), (None, "x", 1), ("x", "x", 1), ("x", "x", 3)])


def test_large_buckets_in_blocks(spark, work, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_SKETCHES", 8)
    monkeypatch.setattr(near_duplicates, "SMALL", 4)
    base = prose(77, 150).split()
    rows = [(i, " ".join(base[: 30 + i % 11] + [f"edit{i}"] + base[30 + i % 11 :])) for i in range(50)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), work).collect()}
    assert got == brute_classes(rows)


def test_recall_of_banding_and_sketches(spark, work):
    # pairs whose similarity is just at or above the threshold
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        words = [f"a{i}x{k}" for k in range(200)]
        other = words.copy()
        for at in rng.choice(np.arange(5, 195, 6), 4, replace=False):
            other[at] = f"b{i}x{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = brute_classes(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), work).collect()}
    assert sum(want[i] == got[i] for i in want) >= 0.998 * len(want)


def test_a_large_group_of_near_copies_in_many_blocks(spark, work, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_TEXTS", 8)
    base = prose(99, 120).split()
    rows = [(i, " ".join(base[: 40 + i % 7] + [f"edit{i}"] + base[40 + i % 7 :])) for i in range(60)]
    rows += [(100 + i, " ".join(base[:60]) + " " + prose(1000 + i, 70)) for i in range(10)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), work).collect()}
    assert got == brute_classes(rows)


def test_components_of_a_long_path(spark, work):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a long, b long")
    assert dict(near_duplicates.components(edges, work).collect()) == {**{i: 0 for i in range(1, 51)}, 101: 100}


def test_empty_blocks_count_no_link_again(spark, work, monkeypatch):
    # two blocks for each pair of near copies: both texts often lie in one, next to an empty block
    monkeypatch.setattr(near_duplicates, "BLOCK_GRAMS", 400)
    rows = [(2 * i + k, prose(1000 + i, 300) + " tail" * k) for i in range(12) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates.near_duplicates(docs, work).collect()
    assert len(got) == 24 and all(r.n_links == r.n_text_links == 1 and r.class_id == r.doc_id // 2 * 2 for r in got)


# --- 6: nearest neighbours


def brute_nearest(rows, k=10):
    rows = sorted({i: v for i, v in rows}.items())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        some = ids != q
        best = np.lexsort((ids[some], d[some]))[:k]
        out[q] = list(zip(ids[some][best].tolist(), d[some][best].tolist(), strict=True))
    return out


def test_nearest_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, DATA, "embeddings").collect()]
    want, got = brute_nearest(rows), {}
    for r in nearest.op6_collision_counting(spark, DATA).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {q: dict(brute_nearest(rows, 10**6)[q]) for q in want}
    assert all(abs(exact[q][i] - s) < 1e-12 for q, found in got.items() for i, s in found)


def test_verified_share_and_recall():
    """At 2,000 vectors under a tenth of the candidates is verified, and at least nine tenths of the nearest are found."""
    import pyarrow.parquet as pq

    rows = [(i, v) for i, v in zip(*(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column(c).to_pylist() for c in ("vec_id", "embedding")), strict=True)]
    ids, x = np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], float)
    lines, want, hits, verified = nearest.Lines.build(ids, x), brute_nearest(rows), 0, 0
    for q in want:
        found, distance, n = lines.nearest(x[ids == q][0], q, 10)
        assert (np.diff(distance) >= 0).all()
        hits += len({i for i, _ in want[q]} & set(ids[found].tolist()))
        verified += n
    assert hits >= 0.9 * 10 * len(want) and verified < 0.1 * len(want) * len(ids)


def test_dimension_keeps_its_promises():
    lines, threshold = nearest.dimension()
    rng, promise = np.random.default_rng(1), {1.0: 1 - nearest.MISS, nearest.RATIO: nearest.FAR}
    for distance, share in promise.items():
        hits = (np.abs(rng.standard_normal((20_000, lines)) * distance) <= nearest.WIDTH / 2).sum(1) >= threshold
        assert hits.mean() >= share - 0.01 if distance == 1 else hits.mean() <= share + 0.005


def test_clusters_are_searched_slab_by_slab(spark, work):
    # four far clusters: a query visits its own alone, and finds what brute force finds
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) + 100 * (i % 4)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, verified = {}, {}
    for r in nearest.neighbours(df, work, block=128).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        verified[r.query_id] = r.verified
    want = brute_nearest(rows)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    assert np.mean(list(verified.values())) < 500


def test_ids_and_dimensions_that_clash(spark, work):
    rows = [(100, [1.0, 0.0]), (100, [0.5, 0.0]), (1, [0.5, 0.1]), (2, [3.0, 0.0]), (2, [0.5, 0.3]), (3, [1.0, 0.0, 0.0]), (200, [2.0])]
    got = nearest.neighbours(spark.createDataFrame([(*r, 0, "y") for r in rows], "vec_id long, embedding array<double>, slab int, bound string"), work).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in got] == [(100, 1, 0.1), (100, 2, 0.3)]


def test_nearest_odd_cases(spark, work, empty):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(250)]
    rows += [(i, [1.0] * 8) for i in range(300, 340)] + [(400, [1.0] * 8), (400, [1.0] * 8)]
    bad = [(500, None), (501, [0.0] * 8), (502, [1.0, None] + [0.0] * 6), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (600, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in nearest.neighbours(df, work, block=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows)
    assert set(got) == set(want)
    assert got[400] == list(range(300, 310)) and got[300] == [*range(301, 311)]
    assert sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    few = nearest.neighbours(df.where("vec_id in (0, 1, 2)"), work).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert nearest.neighbours(df.where("false"), work).collect() == []


# --- 7: WARC


def test_bundles_by_offset():
    import io

    import zstandard

    bundler, records, frames = warc_bundles.Bundler(0, frame=2000, bundle=10**9), {}, []
    for i in range(100):
        records[i] = warc_bundles.record(i, "http://e/é x", prose(i, 20).encode(), "D", None, bundler.place)
        frames += bundler.add(i, records[i])
    frames += bundler.finish()
    bundle = io.BytesIO(b"".join(f["content"] for f in frames))
    assert len(warc_bundles.read_seek_table(bundle)) == len(frames) - 1 > 5
    for f in frames:
        for r in f["records"]:
            assert warc_bundles.read_frame(bundle, f["frame"])[r["offset"] : r["offset"] + r["length"]] == records[r["page_id"]]
    whole = zstandard.ZstdDecompressor().stream_reader(bundle.getvalue(), read_across_frames=True).read()
    assert whole == b"".join(records.values())  # the seek table is a frame that readers skip


def test_pages(spark, work, monkeypatch, tmp_path):
    monkeypatch.setattr(warc_bundles, "FRAME", 200)
    rows = [(1, "u", "<a>"), (2, None, None), (3, "u", ""), (4, "v", "<a>"), (5, "w", "é" * 50_000), (7, "q", "same"), (7, "q", "same"), (8, "q", "same"), (9, "line\nend", "<b>"), (9, "other", "<c>")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, maybe string")
    frames = warc_bundles.write_bundles(pages, work)
    got = warc_bundles.read_bundles(frames, work).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter(
        [(1, "response", None, 3), (4, "revisit", 1, 3), (2, "response", None, 0), (3, "revisit", 2, 0), (5, "response", None, 100_000), (7, "response", None, 4), (7, "revisit", 7, 4), (8, "revisit", 7, 4), (9, "response", None, 3), (9, "response", None, 3)]
    )
    digests = {warc_bundles.digest_of((c or "").encode()) for _, _, c in rows}
    assert {r.payload_digest for r in got} == digests
    empty = warc_bundles.write_bundles(pages.where("false"), work)
    assert warc_bundles.read_bundles(empty, work).collect() == []
    # files: every record is read by seeking from a file's end
    warc_bundles.export_bundles(frames, str(tmp_path))
    index = warc_bundles.index_of(frames).collect()
    assert len(index) == len(rows)
    for r in index:
        with open(tmp_path / f"{r.bundle_id}.warc.zst", "rb") as f:
            head, block, after = warc_bundles.parse_record(memoryview(warc_bundles.read_frame(f, r.frame)), r.offset)
        assert after - r.offset == r.length and head["WARC-Record-ID"].startswith(f"<urn:page:{r.page_id}:")


def test_payloads_below_the_least_size_are_all_responses(spark, work):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = warc_bundles.read_bundles(warc_bundles.write_bundles(pages, work, least=3), work).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(1, None), (2, None), (3, None), (4, 3)}


def test_a_revisit_needs_its_response(spark, work):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa")], "page_id long, url string, html string")
    frames = warc_bundles.write_bundles(pages, work)
    read = frames.mapInArrow(warc_bundles.read_rows, warc_bundles.READ).where("record_type = 'revisit'").collect()
    assert [(r.page_id, r.payload_bytes, r.refers_to) for r in read] == [(2, None, 1)]
    lost = frames.withColumn("records", F.filter("records", lambda r: r["page_id"] == 2))
    with pytest.raises(Exception, match="nothing holds"):
        warc_bundles.read_bundles(lost, work).collect()


def test_a_full_bitmap_is_still_right(spark, work, monkeypatch):
    from mailstruct.llm import common

    monkeypatch.setattr(common, "BITS", 8)
    pages = spark.createDataFrame([(i, "u", f"p{i % 50}" if i < 80 else f"q{i}") for i in range(120)], "page_id long, url string, html string")
    got = warc_bundles.read_bundles(warc_bundles.write_bundles(pages, work), work).collect()
    assert {(r.page_id, r.refers_to) for r in got} == {(i, i - 50 if 50 <= i < 80 else None) for i in range(120)}


def test_pages_without_id(spark, work):
    rows = [(None, "u", "<a>"), (None, "u", "<a>"), (4, "v", "<a>"), (None, None, None), (None, "w", "only"), (None, "w", "only"), (5, "w", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    frames = warc_bundles.write_bundles(pages, work)
    got = warc_bundles.read_bundles(frames, work).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter(
        [(None, "revisit", 4, 3), (None, "revisit", 4, 3), (4, "response", None, 3), (None, "response", None, 0), (None, "response", None, 4), (None, "response", None, 4), (5, "response", None, 1)]
    )
    names = []
    for f in frames.collect():
        plain = memoryview(warc_bundles.plain_frame(bytes(f.content), f.plain_bytes) if f.records else b"")
        names += [warc_bundles.parse_record(plain, r.offset)[0]["WARC-Record-ID"] for r in f.records]
    assert len(set(names)) == len(rows)


def test_op7_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    want = sorted(con.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({warc_bundles.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in warc_bundles.op7_seekable_bundles(spark, DATA).collect()) == want


# --- 8 and 10: classifiers


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("op", "target", "least"), [(rules.op10_rule_ensemble, "quality", 0.95), (toxicity.op8_nearest_examples, "toxic", 0.8)])
def test_held_out_accuracy(spark, op, target, least):
    got = op(spark, SMALL).select("doc_id", "held_out", "score", "predicted").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    joined = got.merge(table(spark, SMALL, "labels").toPandas(), on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = joined[joined.held_out]
    assert auc(held.score.to_numpy(), held[target].to_numpy()) >= least


def test_nearest_examples_equal_brute_force():
    rng = np.random.default_rng(6)
    rows = []
    for i in range(500):
        terms = np.unique(rng.integers(0, 40, rng.integers(0, 6)))
        rows.append((i, int(rng.random() < 0.3), terms, rng.integers(1, 4, len(terms))))
    examples = pd.DataFrame(rows, columns=["doc_id", "y", "terms", "tf"])
    index = toxicity.build([f"t{i}" for i in range(40)], rng.integers(1, 400, 40).astype(float), 1000, examples)
    full = np.zeros((len(index.ids), 40))
    for t, (at, w) in enumerate(index.postings):
        full[at, t] = w
    for _ in range(200):
        terms = np.unique(rng.integers(0, 40, rng.integers(1, 6)))
        vector = index.vector(terms, rng.integers(1, 4, len(terms)))
        score = full[:, terms] @ vector
        found, near = index.nearest(terms, vector, 15)
        want = [i for i in np.lexsort((index.ids, -np.round(score, 12))) if score[i] > 1e-8][:15]
        assert index.ids[found].tolist() == index.ids[want].tolist() and np.allclose(near, np.minimum(score[want], 1))


def test_rules_compile_to_what_they_predict(spark, odd, empty):
    rng = np.random.default_rng(7)
    x = rng.random((600, len(rules.NAMES)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] < 0.6)).astype(float)
    model = rules.fit(x, y)
    assert auc(model.predict(x), y) > 0.97 and 0 < len(model.rules) < 200
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[:50])], "i int, " + rules.STATISTICS)
    got = [r.p for r in rows.orderBy("i").select("i", model.column().alias("p")).collect()]
    assert np.allclose(got, model.predict(x[:50]))
    scored = rules.score(odd, model).collect()
    assert len(scored) == len(ODD) and scored[0].size == "y" and all(0 <= r.score <= 1 for r in scored)
    assert rules.score(empty, model).collect() == []
    assert rules.fit(np.zeros((0, len(rules.NAMES))), np.zeros(0)).rules == [] and rules.fit(x, np.ones(600)).rules == []


def test_op10_against_brute_force(spark):
    """Statistics counted one by one, and rules applied one by one, give the query's scores."""
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    model = rules.train(docs, table(spark, DATA, "labels"))
    got = {r.doc_id: r.score for r in rules.op10_rule_ensemble(spark, DATA).collect()}

    def count(t):
        words, lines = t.split(), [x for x in t.split("\n") if x]
        share = lambda a, b: a / b if b else 0.0
        spaces = sum(c in " \t\n\r\x0b\x0c" for c in t)
        upper = sum("A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" and c != "\u00d7" for c in t)
        symbols = sum("!" <= c <= "~" and not c.isalnum() and c not in rules.PROSE for c in t)
        return [float(len(t)), share(len(t) - spaces, len(words)), share(upper, len(t)), share(symbols, len(t)), share(sum("0" <= c <= "9" for c in t), len(t)), share(len(set(words)), len(words)), share(sum(a == b for a, b in zip(words[:-1], words[1:], strict=True)), len(words)), share(len(set(lines)), len(lines)), share(len(words), len(lines))]

    for d in docs.collect():
        x, total = count(d.text or ""), model.intercept
        for rule, w in zip(model.rules, model.weights, strict=True):
            total += w * all((x[i] > cut) if above else (x[i] <= cut) for i, above, cut in rule.tests)
        assert got[d.doc_id] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_statistics():
    got = dict(zip(rules.NAMES, rules.statistics(pa.array(["", "ABC déf! 1$\nABC déf! 1$\nÉ a a", "x"]))[1], strict=True))
    assert got["chars"] == 29 and got["upper"] == 7 / 29 and got["symbols"] == 2 / 29 and got["digits"] == 2 / 29
    assert got["different_words"] == 5 / 9 and got["repeated_words"] == 1 / 9 and got["different_lines"] == 2 / 3 and got["line_words"] == 3


def test_op8_against_brute_force(spark):
    """Every score and every voter of all documents, from whole weight vectors compared with all examples."""
    docs = {d.doc_id: d.text or "" for d in table(spark, DATA, "documents").collect()}
    toxic = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").collect() if r.toxic is not None}
    terms = {i: Counter(toxicity.TERM.findall(t.lower())) for i, t in docs.items()}
    examples = sorted(i for i in toxic if i in docs and zlib.crc32(str(i).encode()) % 5 and terms[i])
    n, positive = len([i for i in toxic if i in docs and zlib.crc32(str(i).encode()) % 5]), sum(toxic[i] for i in toxic if i in docs and zlib.crc32(str(i).encode()) % 5)
    df, seen, hits = Counter(t for c in terms.values() for t in c), Counter(t for i in examples for t in terms[i]), Counter(t for i in examples if toxic[i] for t in terms[i])

    def weigh(c):
        out = {}
        for t, tf in c.items():
            if t in seen:
                odds = hits[t] * (n - positive - (seen[t] - hits[t])) - (seen[t] - hits[t]) * (positive - hits[t])
                spread = seen[t] * (n - seen[t]) * positive * (n - positive)
                chi = n * odds * odds / spread if spread else 0.0
                out[t] = (1 + np.log(tf)) * (np.log((1 + len(docs)) / (1 + df[t])) + 1) * (1 + np.sqrt(chi))
        length = np.sqrt(sum(w * w for w in out.values()))
        return {t: w / length for t, w in out.items()}

    held = {i: weigh(terms[i]) for i in examples}
    got = {r.doc_id: r for r in toxicity.op8_nearest_examples(spark, DATA).collect()}
    assert set(got) == set(docs)
    votes = {}
    for i in docs:
        own = weigh(terms[i])
        near = sorted(((round(s, 12), -e) for e in examples if (s := sum(w * held[e].get(t, 0.0) for t, w in own.items())) > 1e-8), reverse=True)[:15]
        assert [v.example for v in got[i].evidence] == [-e for _, e in near]
        assert np.allclose([v.similarity for v in got[i].evidence], [min(s, 1) for s, _ in near], atol=1e-9)
        assert [v.label for v in got[i].evidence] == [toxic[-e] for _, e in near]
        if near:
            w = [1 / (1.05 - min(s, 1)) for s, _ in near]
            votes[i] = sum(a * toxic[-e] for a, (_, e) in zip(w, near, strict=True)) / sum(w)
    # scores rise with votes
    order = sorted(votes, key=votes.get)
    assert all(got[a].score <= got[b].score + 1e-12 for a, b in zip(order[:-1], order[1:], strict=True))


def test_blocks_are_skipped():
    rng = np.random.default_rng(9)
    rows = []
    for i in range(2000):  # ten languages with terms of their own
        terms = np.unique(rng.integers(0, 60, 30)) + 60 * (i % 10)
        rows.append((i, i % 2, terms, np.ones(len(terms), np.int64)))
    index = toxicity.build([f"t{i}" for i in range(600)], np.full(600, 300.0), 4000, pd.DataFrame(rows, columns=["doc_id", "y", "terms", "tf"]))
    index.scored = index.asked = 0
    index.nearest_all([(r[2], index.vector(r[2], r[3])) for r in rows], 15)
    assert index.scored < 0.5 * index.asked


def test_examples_are_ordered_within_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    terms = [np.unique(rng.integers(0, 5000, 300)).astype(np.int32) for _ in range(4096)]
    rows = pd.DataFrame([(i, i % 10 == 0, t, np.ones(len(t), np.int32)) for i, t in enumerate(terms)], columns=["doc_id", "y", "terms", "tf"])
    tracemalloc.start()
    order = toxicity.by_likeness(rows, np.ones(5000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order) == list(range(4096)) and peak < 40 * sum(map(len, terms))


def test_toxicity_odd_cases(spark, odd, empty, work):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    index = toxicity.train(odd.select("doc_id", "text"), labels, work)
    got = toxicity.score(odd, index).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and got[0].bands == "z"
    assert toxicity.score(empty, toxicity.train(empty.select("doc_id", "text"), labels, work)).collect() == []


def test_every_term_is_searched(spark, work):
    # an exact copy of a toxic example that shares no frequent term with others is found at similarity 1
    rows = [(i, prose(i, 40)) for i in range(60)] + [(100, "seldom heard syllables"), (101, "Seldom heard, syllables")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)] + [(100, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels, work)).collect()}
    assert got[101].evidence[0].example == 100 and got[101].evidence[0].similarity == pytest.approx(1)
    assert all(r.evidence for r in got.values())


@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.01"])
def test_toxic_documents_leave_the_stage(spark, data):
    import corpus_pipeline

    kept = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, table(spark, data, "documents"), data).select("doc_id").collect()}
    toxic = {0: set(), 1: set()}
    for r in table(spark, data, "labels").where("toxic is not null").collect():
        toxic[r.toxic].add(r.doc_id)
    assert len(toxic[1] & kept) <= 0.2 * len(toxic[1]) and len(toxic[0] & kept) >= 0.9 * len(toxic[0])


# --- 9: mixing


def test_targets():
    got = mixing.targets([100, 10, 50], [3, 1, 2], 1.5, 2)
    assert sum(got) == pytest.approx(240) and got[1] == 20 and all(t <= 2 * s for t, s in zip(got, [100, 10, 50], strict=True))
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [3, 1]) == [0, 0]


def test_fit_hits_the_budget_where_it_can():
    rng = np.random.default_rng(8)
    for t in range(400):
        lengths = np.unique(rng.integers(1, 40 if t % 2 else 900, rng.integers(1, 8))) * int(rng.integers(1, 4))
        counts = rng.integers(1, 9, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        taken = mixing.fit(lengths, counts, budget, 1)
        assert (0 <= taken).all() and (taken <= counts).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert int((taken * lengths).sum()) == min(sums, key=lambda s: (abs(s - budget), s))


def test_fit_with_a_very_long_text():
    lengths = np.append(np.arange(1, 900), 5_000_000)
    counts = np.full(len(lengths), 7)
    for budget in (11_234_567, 2_000_003, 30_500_000):
        assert int((mixing.fit(lengths, counts, budget, 1) * lengths).sum()) == budget


def test_large_budgets_get_the_nearest_sum():
    """Few long lengths, budgets beyond the reach of an array: every sum of the counts by brute force."""
    rng = np.random.default_rng(5)
    for case in range(24):
        lengths = np.sort(rng.choice(np.arange(1_000_000, 3_000_000), 4, replace=False))
        if case % 3 == 2:
            lengths *= 2  # a common divisor
        counts = rng.integers(1, 9, 4)
        budget = int(rng.integers(5_000_000, 50_000_000))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = mixing.fit(lengths, counts, budget, case)
        assert (taken >= 0).all() and (taken <= counts).all()
        assert int((taken * lengths).sum()) == min(sums, key=lambda s: (abs(s - budget), s))


def test_op9_against_targets_worked_out_apart(spark):
    docs = table(spark, SMALL, "documents").collect()
    import re

    size, source = {}, {}
    for d in docs:
        size[d.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        source.setdefault(d.source, []).append(d.doc_id)
    names = sorted((s for s in source if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in source else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[i] for i in source[s]) for s in names}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > 2 * total[s]]
        for s in over or open_:
            target[s] = 2.0 * total[s] if over else left * weight[s] / whole
        left -= sum(target[s] for s in over)
        open_ = open_ - set(over) if over else set()
    rows = mixing.op9_budget_fit(spark, SMALL).collect()
    assert Counter((r.doc_id, r["size"], r.source_size) for r in rows) == Counter((d.doc_id, size[d.doc_id], total[d.source]) for d in docs)
    assert all(r.target == pytest.approx(target[r.source]) and r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    for s in names:
        mine = sum(r.taken for r in rows if r.source == s)
        whole = int(min(target[s] // total[s], 2)) * total[s]
        reached = 1
        for i in source[s] if whole < 2 * total[s] else []:
            reached |= reached << size[i]
        sums = [whole + k for k in range(reached.bit_length()) if reached >> k & 1]
        assert abs(mine - target[s]) <= min(abs(x - target[s]) for x in sums) + 1e-6


def test_mixing(spark, odd, empty, work):
    rows = mixing.op9_budget_fit(spark, SMALL).collect()
    again = mixing.op9_budget_fit(spark, SMALL).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again)) and len(rows) == 1000
    taken = {}
    for r in rows:
        assert r.taken <= 2 * r["size"]
        taken.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 5 for (_, target), t in taken.items())
    got = mixing.mix(odd, work).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
    assert mixing.mix(empty, work).collect() == []


def test_one_length_that_holds_many_rows(spark, work):
    docs = spark.createDataFrame([(i, "a b c d", "s0" if i % 4 else "s1") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix(docs, work).groupBy("source").agg(F.sum(F.col("size") * F.col("epochs")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 4 for r in got)
