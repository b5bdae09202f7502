"""N-gram Jaccard join by MinHash banding.

Documents with equal words are one text, named by a digest of them. Each text's signature is cut into bands; rows and bands
are chosen for a target recall at the threshold. Texts meet in the buckets of their band hashes; buckets with the same members
are one. Members of a bucket are compared pair by pair on a byte of each of their hashes, which drops all pairs but for those
that may well reach the threshold (a second bound on recall), so texts that share some boilerplate do not grow together. What
is left is verified on full sets of word n-grams: connected texts are dealt into blocks, and pairs of blocks are verified by
matrix products, which give each text its number of links and a spanning forest. So no task holds more than two blocks, texts
move once, and no pair of texts ever becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailstruct.llm.common import Workspace, forget, maybe_among, table, text_of

WORDS, THRESHOLD, RECALL, HASHES, SEED = 5, 0.8, 0.9999, 256, 11
#: A block of candidates has about so many texts, and about so many n-grams.
BLOCK_TEXTS, BLOCK_GRAMS = 96, 1_000_000
#: Buckets of up to so many texts are compared many at a time; larger ones are dealt into blocks of so many sketches.
SMALL, BLOCK_SKETCHES = 16, 512


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands find a pair at the threshold with the recall, in so many hashes."""
    best = None
    for rows in range(1, hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall with so few hashes")
    return best


def least_equal(hashes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """How many of so many hashes a pair at the threshold has equal at least, but for a chance of 1 - recall."""
    below, n = 0.0, -1
    while below <= 1 - recall:
        n += 1
        below += math.comb(hashes, n) * threshold**n * (1 - threshold) ** (hashes - n)
    return n


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (white-space runs apart, lower case), and where each text's begin (one more than the texts)."""
    import xxhash

    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    coded = pc.dictionary_encode(split.values)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes, starts = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    words = known[codes] if len(codes) else np.empty(0, np.uint64)
    # splitting leaves empty words at the ends of a text and for an empty one
    empty = np.flatnonzero(known == np.uint64(xxhash.xxh3_64_intdigest("")))
    if len(empty):
        real = codes != empty[0]
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        words = words[real]
    return words, starts


def grams(words: np.ndarray, starts: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word n-grams, in order; a text of 1 to n - 1 words has one gram of them all, an empty one none."""
    sizes = np.diff(starts)
    with np.errstate(over="ignore"):
        length = len(words) - n + 1
        if length > 0:
            rolled = np.zeros(length, np.uint64)
            for k in range(n):
                rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + length])
        else:
            rolled = np.empty(0, np.uint64)
        counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(first[-1], np.uint64)
        long = sizes >= n
        at = np.repeat(starts[:-1][long] - (np.cumsum(counts[long]) - counts[long]), counts[long]) + np.arange(counts[long].sum())
        out[np.repeat(long, counts)] = rolled[at]
        for i in np.flatnonzero((sizes > 0) & ~long):
            h = np.uint64(sizes[i])
            for w in words[starts[i] : starts[i + 1]]:
                h = mixed(np.array([h * np.uint64(0x9E3779B97F4A7C15) + w]))[0]
            out[first[i]] = h
    return out, first


SIGNED = "digest binary, n_grams long, bands array<long>, sketch binary"


def signer(bands: int, rows: int, key: pa.DataType):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replaces texts by digest, number of n-grams, band hashes and sketch; texts without words have no bands."""
        import xxhash

        forget()
        random = np.random.default_rng(SEED)
        times = random.integers(0, 2**32, bands * rows, np.uint32) | np.uint32(1)
        plus = random.integers(0, 2**32, bands * rows, np.uint32)
        for batch in batches:
            words, starts = word_hashes(batch.column("text"))
            found, first = grams(words, starts)
            some = np.flatnonzero(np.diff(first) > 0)
            folded = (found >> np.uint64(32)).astype(np.uint32)
            keys, sketch = np.zeros((len(some), bands), np.uint64), np.zeros((len(some), bands * rows), np.uint8)
            with np.errstate(over="ignore"):
                for band in range(bands):
                    h = np.full(len(some), band + 1, np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        least = np.minimum.reduceat((folded ^ plus[k]) * times[k], first[some]) if len(some) else folded
                        sketch[:, k] = mixed(least.astype(np.uint64)) & np.uint64(255)
                        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + least)
                    keys[:, band] = h
            digests = [xxhash.xxh3_128_digest(words[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            cuts, sketches = np.zeros(batch.num_rows + 1, np.int32), [b""] * batch.num_rows
            cuts[some + 1] = bands
            for i, row in zip(some, sketch, strict=True):
                sketches[i] = row.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(cuts, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            named = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"digest": pa.array(digests, pa.binary()), "n_grams": pa.array(np.diff(first), pa.int64()), "bands": lists, "sketch": pa.array(sketches, pa.binary())}
            del named["text"]
            yield pa.RecordBatch.from_arrays([named["doc_id"].cast(key), *list(named.values())[1:]], list(named))

    return sign


def alike(least: int):
    """Of rows (bucket, i, j, side, digest, sketch) that come by bucket, i, j and digest: an edge (a, b) from each text to the
    first that it is connected with by pairs of so many equal bytes. Buckets of one group of copies give the same edges."""

    def roots(near: np.ndarray) -> np.ndarray:
        """Of each graph (graph, node, node) the first node that each node is connected with."""
        size = near.shape[1]
        near = near | np.eye(size, dtype=bool)
        root = np.broadcast_to(np.arange(size), near.shape[:2])
        while True:
            new = np.where(near, root[:, None, :], size).min(2)
            if (new == root).all():
                return new
            root = new

    def large(sketches: np.ndarray, side: np.ndarray | None) -> np.ndarray:
        near = np.stack([(sketches == one).sum(1) >= least for one in sketches])
        if side is not None:
            near &= side[:, None] != side[None]
        root = np.arange(len(sketches))
        for i in range(len(sketches)):
            front = np.array([i])
            while len(front) and root[i] == i:
                reached = np.flatnonzero(near[front].any(0) & (root == np.arange(len(root))) & (np.arange(len(root)) > i))
                root[reached] = i
                front = reached
        return root

    def compare(table: pa.Table, width: int) -> pa.RecordBatch:
        digests = table.column("digest").to_pylist()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(digests), width)
        keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        sizes, root = np.diff(np.append(starts, len(keys))), np.arange(len(keys))
        within = keys[starts, 1] == keys[starts, 2]
        for size in range(2, SMALL + 1):
            every = starts[(sizes == size) & within]
            for at in range(0, len(every), 4096 // size):
                rows = every[at : at + 4096 // size, None] + np.arange(size)
                some = sketches[rows]
                near = (some[:, :, None] == some[:, None]).sum(3) >= least
                root[rows] = np.take_along_axis(rows, roots(near), 1)
        for start, size, own in zip(starts, sizes, within, strict=True):
            if size > 1 and (size > SMALL or not own):
                some = slice(start, start + size)
                root[some] = start + large(sketches[some], None if own else table.column("side").to_numpy()[some])
        edges = {(digests[i], digests[root[i]]) for i in np.flatnonzero(root != np.arange(len(root)))}
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            now, last = pa.Table.from_batches(held), batch.num_rows - 1
            # all but the group that the batch ends with, which may go on
            open_ = pc.and_(pc.and_(pc.equal(now.column("bucket"), batch.column("bucket")[last]), pc.equal(now.column("i"), batch.column("i")[last])), pc.equal(now.column("j"), batch.column("j")[last]))
            done = now.filter(pc.invert(open_))
            if done.num_rows:
                yield compare(done, len(batch.column("sketch")[0].as_py()))
                held = now.filter(open_).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held), len(held[0].column("sketch")[0].as_py()))

    return run


def blocks_of(group: list[str], block: Column, blocks: Column, *keep: str, order: str) -> Callable[[DataFrame], DataFrame]:
    """Deals the rows of each group to all pairs (i, j) of its blocks; side tells the two blocks of a pair apart."""
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(block, other).alias("i"), F.greatest(block, other).alias("j"), (other < block).cast("int").alias("side")))
    return lambda rows: rows.select(*group, *keep, F.explode(pairs).alias("p")).select(*group, "p.i", "p.j", "p.side", *keep).repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j", order)


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root): root is the smallest node of node's component, for the nodes of edges (a, b) that aren't roots.

    Alternating large and small stars; each round is written, so lineage stays short.
    """
    now = work.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not is_star_forest(now):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join meets two plain shuffles and Spark can split a star's center
        least = work.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = work.write(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        work.drop(now, least)
        least = work.write(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b")))
        now = work.write(small.distinct(), "small")
        work.drop(large, least)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def is_star_forest(edges: DataFrame) -> bool:
    """Whether every node of edges (a > b) has one parent, which has none."""
    if edges.groupBy("a").count().where("count > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()


def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces texts by their sets of n-grams (sorted 64-bit hashes)."""
    for batch in batches:
        found, first = grams(*word_hashes(batch.column("text")))
        sets = [np.unique(found[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        at = batch.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], ["grams" if i == at else n for i, n in enumerate(batch.schema.names)])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The size of each pair's intersection."""
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], float)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[number] > 1
    owner, number = owner[shared], (np.cumsum(often > 1) - 1)[number[shared]]
    out = np.zeros((len(sets), len(sets)))
    by = np.argsort(number, kind="stable")
    owner, number = owner[by], number[by]
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 8192):
        a, b = np.searchsorted(number, [low, low + 8192])
        x = np.zeros((len(sets), 8192), np.float32)
        x[owner[a:b], number[a:b] - low] = 1
        out += x @ x.T
    return out


def verifier(threshold: float):
    """Of rows (root, i, j, side, node, n, grams) that come by root, i and j: each text's links found there, and b, the first text that it is connected with."""

    def close(nodes: list[bytes], copies: np.ndarray, grams: list[bytes], side: np.ndarray, across: bool) -> list[tuple]:
        sets = [np.frombuffer(g, np.uint64) for g in grams]
        size, both = np.array([len(s) for s in sets], float), overlaps(sets)
        linked = both / np.maximum(size[:, None] + size[None] - both, 1) >= threshold
        linked &= (side[:, None] != side[None]) if across else ~np.eye(len(nodes), dtype=bool)
        texts, documents, out, seen = linked.sum(1), linked @ copies, [], np.zeros(len(nodes), bool)
        for i in sorted(np.flatnonzero(texts).tolist(), key=nodes.__getitem__):
            reach = np.zeros(len(nodes), bool)
            front = np.array([i])
            while len(front) and not seen[i]:
                reach[front] = True
                front = np.flatnonzero(linked[front].any(0) & ~reach)
            out += [(nodes[j], nodes[i], int(texts[j]), int(documents[j])) for j in np.flatnonzero(reach & ~seen)]
            seen |= reach
        return out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, ([], [], [], []), []

        def end() -> None:
            if len(rows[0]) > 1:
                # a block whose partner is empty has side 0 only, and its own links are found within itself
                found.extend(close(rows[0], np.array(rows[1], np.int64), rows[2], np.array(rows[3]), key[1] != key[2]))

        for batch in batches:
            for *now, node, n, grams, side in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "n", "grams", "side")), strict=True):
                if now != key:
                    end()
                    key, rows = now, ([], [], [], [])
                for column, x in zip(rows, (node, n, grams, side), strict=True):
                    column.append(x)
            yield batch_of(found)
            found = []
        end()
        yield batch_of(found)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["a", "b", "texts", "documents"])

    return verify


def candidates_of(texts: DataFrame, work: Workspace, least: int) -> DataFrame:
    """Edges (a, b) between texts (digest, bands, sketch) that share a bucket and have so many equal bytes of their sketches.

    Edges connect all such texts, at most one for each text in a bucket.
    """
    banded = texts.select("digest", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("digest").alias("least"), *(F.bit_xor(F.xxhash64(F.lit(k), "digest")).alias(f"x{k}") for k in (0, 1))).where("size > 1")
    buckets = work.write(buckets.groupBy("size", "least", "x0", "x1").agg(F.min("band").alias("band")).select("band", "size"), "buckets")
    members = work.write(banded.join(buckets, "band"), "bucket_members")
    members = members.join(texts.select("digest", "sketch"), "digest").select(F.col("band").alias("bucket"), "digest", "sketch", F.ceil(F.col("size") / BLOCK_SKETCHES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = blocks_of(["bucket"], block, F.col("blocks"), "digest", "sketch", order="digest")(members)
    return dealt.mapInArrow(alike(least), "a binary, b binary")


def near_duplicates(docs: DataFrame, work: Workspace, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, class_id, n_links, copy_id, n_copies, n_text_links.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles reaches the threshold; words are
    runs between white space, in lower case. class_id is the smallest doc_id among all documents connected by links,
    copy_id that among documents with equal words, of which there are n_copies. n_links counts all other linked documents,
    copies among them; n_text_links the linked texts. Null texts count as empty; empty texts are copies of each other and
    link to nothing else; texts of one to four words have one shingle. Very long texts are compared whole. Repeated rows are
    copies. Rows go by their own text, also if they share a doc_id. Rows without doc_id take part; class_id and copy_id are
    null only where no document has an id. doc_id may be of any type that has an order. An empty table gives an empty
    result; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bands, rows = choose_bands(threshold, recall)
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", text_of().alias("text"))
    # a row of a text is found again by its id and these
    raw = [F.xxhash64(F.lit(k), "text").alias(f"raw{k}") for k in (0, 1)]
    signed = docs.select("doc_id", *raw, "text").mapInArrow(signer(bands, rows, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, raw0 long, raw1 long, {SIGNED}")
    signed = work.write(signed, "signed")
    texts = work.write(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "raw0", "raw1")).alias("carrier"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("n_grams", "bands", "sketch"))), "texts")

    edges = candidates_of(texts, work, least_equal(bands * rows, threshold, recall))
    candidates = components(edges, work)
    candidates = work.write(candidates.unionAll(candidates.select(F.col("root").alias("node"), "root").distinct()), "candidates")
    members = work.write(candidates.join(texts.select(F.col("digest").alias("node"), "carrier", "n", "n_grams"), "node"), "members")

    load = members.groupBy("root").agg(F.count("*").alias("t"), F.sum("n_grams").alias("g"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("t") / BLOCK_TEXTS), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")
    placed = members.join(load.select("root", blocks.alias("blocks")), "root").select("node", "root", "n", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("carrier.doc_id").alias("id"), F.col("carrier.raw0").alias("r0"), F.col("carrier.raw1").alias("r1"))
    placed = work.write(placed, "placed")
    # a bitmap of fixed size tells which texts may be candidates, and only these move; merged at every size, as candidates grow
    maybe = maybe_among(F.col("raw0"), placed.select(F.col("r0").alias("digest")))
    found = maybe(docs.select("doc_id", *raw, "text")).where("maybe").join(placed.hint("merge"), F.col("raw0").eqNullSafe(F.col("r0")) & F.col("raw1").eqNullSafe(F.col("r1")) & F.col("doc_id").eqNullSafe(F.col("id")))
    sets = found.select("text", "node", "root", "n", "block", "blocks").mapInArrow(gram_rows, "grams binary, node binary, root binary, n long, block int, blocks int")
    repeats = signed.groupBy("doc_id", "raw0", "raw1").count().where("count > 1").limit(1).count() > 0
    sets = work.write(sets.dropDuplicates(["node"]) if repeats else sets, "sets")
    dealt = blocks_of(["root"], F.col("block"), F.col("blocks"), "node", "n", "grams", order="node")(sets)
    links = work.write(dealt.mapInArrow(verifier(threshold), "a binary, b binary, texts long, documents long"), "links")

    work.drop(sets, members, placed)
    counted = links.groupBy("a").agg(F.sum("texts").alias("n_text_links"), F.sum("documents").alias("linked"))
    rooted = components(links.select("a", "b"), work)
    slim = texts.select("digest", "rep", "n").join(counted.withColumnRenamed("a", "digest"), "digest", "left").join(rooted.withColumnRenamed("node", "digest"), "digest", "left")
    slim = work.write(slim.withColumn("root", F.coalesce("root", "digest")), "slim")
    classes = slim.where("n_text_links > 0").groupBy("root").agg(F.min("rep").alias("least"))
    slim = slim.join(classes, "root", "left")
    slim = slim.select("digest", F.coalesce("least", "rep").alias("class_id"), F.col("rep").alias("copy_id"), F.col("n").alias("n_copies"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "digest").join(slim, "digest").select("doc_id", "class_id", "n_links", "copy_id", "n_copies", "n_text_links")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark))
