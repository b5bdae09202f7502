"""Source divergence audit: how far the sources of a language use their words differently.

Tasks count terms for each language and source before anything moves; one shuffle by language and term then gives each term's sparse
vector of counts by source. Terms with equal vectors are one row with a multiplicity from there on, and every pair of sources is
evaluated once for each distinct vector. Since a source's share depends on a term's count alone, a pair's sum splits into a part
for each source's counts (a histogram) and one for vectors that hold both sources:

    sum f(p, q) = V f(p0, q0) + sum_p [f(p, q0) - f(p0, q0)] + sum_q [f(p0, q) - f(p0, q0)]
                  + sum_both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

with p0, q0 the shares of a term that does not occur. All arithmetic is in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailstruct.llm.common import Workspace, table, text_of, trim

LEAST, TOP, ONE = 10, 10, 1_000_000_000
#: Words that a task counts before it hands its sums on, and (language, source) groups that are sent to all tasks at most.
HELD, GROUPS = 2_000_000, 100_000
#: Counts whose product with ONE fits into 64 bits.
NARROW = 9_000_000_000
#: ASCII letters in lower case; every other ASCII character separates terms; bytes of other characters stay.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalpha() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents, summed over up to HELD words."""
    words: list[pa.Array] = []
    sizes: list[int] = []
    groups: list[int] = []
    numbers: dict[tuple[str, str], int] = {}

    def given() -> Iterator[pa.RecordBatch]:
        """One sort by group, term and document gives both sums."""
        if not sizes:
            return
        coded = pa.concat_arrays(words).dictionary_encode()
        terms, doc = coded.dictionary, np.repeat(np.arange(len(sizes)), sizes)
        cell = np.array(groups)[doc] * len(terms) + coded.indices.to_numpy()
        if (int(cell.max()) + 1) * len(sizes) < 2**63:
            key = cell * len(sizes) + doc
            key.sort()
            cell, doc = np.divmod(key, len(sizes))
        else:
            order = np.lexsort((doc, cell))
            cell, doc = cell[order], doc[order]
        first = np.concatenate([[True], cell[1:] != cell[:-1]])
        at = np.flatnonzero(first)
        n, docs = np.diff(np.append(at, len(cell))), np.add.reduceat(first | np.concatenate([[True], doc[1:] != doc[:-1]]), at, dtype=np.int64)
        group, code = np.divmod(cell[at], len(terms))
        cuts = np.searchsorted(group, np.arange(len(numbers) + 1))
        for (lang, source), low, high in zip(numbers, cuts[:-1], cuts[1:], strict=True):
            term = terms.take(pa.array(code[low:high])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, high - low), pa.repeat(source, high - low), term, pa.array(n[low:high]), pa.array(docs[low:high])], ["lang", "source", "term", "n", "docs"])
        for held in (words, sizes, groups, numbers):
            held.clear()
        trim()

    held = 0
    for batch in batches:
        folded = pa.array([t.as_py().translate(FOLD) for t in batch.column("text")], pa.large_binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(folded)
        # splitting leaves empty words at the ends of a text and for an empty one
        real = pc.not_equal(split.values, "")
        found, starts = split.values.filter(real), np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()]
        begun = 0
        for i, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            size = int(starts[i + 1] - starts[i])
            if size:
                sizes.append(size)
                groups.append(numbers.setdefault((lang, source), len(numbers)))
                held += size
            if held >= HELD:
                words.append(found[starts[begun] : starts[i + 1]])
                yield from given()
                begun, held = i + 1, 0
        words.append(found[starts[begun] :])
    yield from given()


def share(n: Column | str, size: str) -> Column:
    """1 + floor(ONE * (n + 2) / size), exactly; in 64 bits where they hold it, since decimals of more take many times as long."""
    n = F.col(n) if isinstance(n, str) else n
    top = (n + 2).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")
    wide = F.call_function("div", top, F.col(size).cast("decimal(20,0)"))
    return F.when(n < NARROW, F.call_function("div", (n.cast("long") + 2) * F.lit(ONE).cast("long"), F.col(size))).otherwise(wide) + 1


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def audit(docs: DataFrame, work: Workspace, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank), parts `pair` and `term`.

    Null text, lang and source count as ''. Groups without kept terms get their pairs all the same. Repeated rows are documents of
    their own. Ties go to the smaller item by its bytes. An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), text_of().cast("binary").alias("text"))
    dealt = docs.mapInArrow(counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    terms = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    kept = work.write(terms.where(F.col("docs") >= least).select("lang", "term", "counts"), "kept")
    vectors = work.write(kept.groupBy("lang", "counts").agg(F.count("*").alias("terms")), "vectors")
    cells = vectors.select("lang", "terms", F.inline("counts"))
    counts = work.write(cells.groupBy("lang", "source", "n").agg(F.sum("terms").alias("terms")), "counts")
    stats = work.write(sizes(docs, vectors, counts), "stats")
    stats = F.broadcast(stats) if stats.count() <= GROUPS else stats
    return pairs(vectors, counts, stats).unionByName(leading(kept, vectors, stats, top))


def sizes(docs: DataFrame, vectors: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, v, size, whole): V, N + 2 V of each group that occurs, and the same of its language."""
    groups = docs.select("lang", "source").distinct()
    n = counts.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("n"))
    v = vectors.groupBy("lang").agg(F.sum("terms").alias("v"))
    whole = n.groupBy("lang").agg(F.sum("n").alias("whole"))
    out = groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").join(whole, "lang", "left").na.fill(0, ["n", "v", "whole"])
    return out.select("lang", "source", "v", (F.col("n") + 2 * F.col("v")).alias("size"), (F.col("whole") + 2 * F.col("v")).alias("whole"))


def pairs(vectors: DataFrame, counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Each other source of a group, by its divergence."""
    mine = stats.select("lang", "source", F.col("size").alias("size_p"), F.when(F.col("v") > 0, share(F.lit(0), "size")).alias("p0"))
    other = stats.select("lang", F.col("source").alias("item"), F.col("size").alias("size_q"), F.when(F.col("v") > 0, share(F.lit(0), "size")).alias("q0"), "v")
    unlike, key = F.col("source") != F.col("item"), ["lang", "source", "item"]
    none = mine.join(other, "lang").where(unlike).select(*key, F.when(F.col("v") > 0, F.col("v") * apart("p0", "q0")).otherwise(0).alias("value"))
    one = counts.join(mine, ["lang", "source"]).withColumn("p", share("n", "size_p")).join(other, "lang").where(unlike)
    one = one.select(*key, (F.col("terms") * (apart("p", "q0") - apart("p0", "q0"))).alias("value")).groupBy(*key).agg(F.sum("value").alias("value"))
    # sources of a vector are sorted, so each pair comes up once, and equal counts of a pair are evaluated once
    each = vectors.where(F.size("counts") > 1).select("lang", "terms", "counts", F.posexplode("counts").alias("place", "one"))
    each = each.select("lang", "terms", "one.source", "one.n", F.explode(F.slice("counts", F.col("place") + 2, F.size("counts"))).alias("two"))
    each = each.groupBy("lang", "source", "n", F.col("two.source").alias("item"), F.col("two.n").alias("m")).agg(F.sum("terms").alias("terms"))
    each = each.join(mine, ["lang", "source"]).join(other, ["lang", "item"]).withColumns({"p": share("n", "size_p"), "q": share("m", "size_q")})
    change = apart("p", "q") - apart("p", "q0") - apart("p0", "q") + apart("p0", "q0")
    each = each.select(*key, (F.col("terms") * change).alias("value")).groupBy(*key).agg(F.sum("value").alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    value = none.unionAll(one).unionAll(turned(one)).unionAll(each).unionAll(turned(each)).groupBy(*key).agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def leading(kept: DataFrame, vectors: DataFrame, stats: DataFrame, top: int) -> DataFrame:
    """The terms of each group that it uses more than its language, by divergence.

    Vectors are ranked first. Of equal vectors all terms are equal, and a vector with top better ones has no term among the first.
    """
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x.n)
    found = vectors.select("lang", "counts", total.alias("total"), F.inline("counts")).join(stats, ["lang", "source"])
    found = found.withColumns({"p": share("n", "size"), "q": share("total", "whole")}).where("p > q").withColumn("value", apart("p", "q"))
    group = Window.partitionBy("lang", "source")
    best = found.withColumn("rank", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("rank") <= top).select("lang", "counts", "source", "value")
    rank = F.row_number().over(group.orderBy(F.desc("value"), "term"))
    out = kept.join(best, ["lang", "counts"]).withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), Workspace(spark))


#: Every term, pair and group on its own, in 128-bit integers.
ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    n AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    langs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    sizes AS (SELECT groups.lang, groups.source, sum(coalesce(n, 0)) AS size FROM groups LEFT JOIN n USING (lang, source) GROUP BY ALL),
    p AS (SELECT groups.lang, groups.source, kept.term, coalesce(n, 0) AS n,
            1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (size + 2 * v)::HUGEINT AS p
        FROM groups JOIN kept USING (lang) JOIN langs USING (lang) JOIN sizes USING (lang, source) LEFT JOIN n USING (lang, source, term)),
    q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)::HUGEINT) // (any_value(size) + 2 * any_value(v))::HUGEINT AS q
        FROM p JOIN langs USING (lang) JOIN (SELECT lang, sum(size) AS size FROM sizes GROUP BY lang) USING (lang) GROUP BY lang, term),
    pair AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
    found AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    rows AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pair LEFT JOIN found USING (lang, source, item)
        UNION ALL SELECT lang, source, 'term', item, value::BIGINT FROM term)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows QUALIFY part = 'pair' OR rank <= 10
"""
