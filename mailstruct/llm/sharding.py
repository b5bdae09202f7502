"""K-d tree sharding by bytes.

Documents are points in their metadata (size, language, source, id). A node that must hold several shards is split along its
widest dimension at the weighted quantile that gives each side its part of the bytes, until each leaf is a shard of the target
size. All nodes of a level are split at once, by one plan over the slim units: spans of every node, then histograms that look
ever closer into the bin that holds the quantile. Units carry their node, nodes are rows of a table, and nothing of the tree
is held by the driver. Everything is DataFrame operations.

Documents with equal texts are one unit. Only if together they outweigh a whole shard, so that no shard could hold them, are
they spread by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from mailstruct.llm.common import Workspace, table, text_of

SHARDS, SLOT_ROWS = 24, 100_000
DIMENSIONS = ("size", "lang", "source", "doc_id")
#: Bins of a histogram, and how often it looks closer: 30 of a key's bits.
BINS, PASSES = 1 << 15, 2
#: Bits of a coordinate and of the hash behind it. A value that all units share is so cut to one part in 2 ** 12.
BITS, TIE = 18, 30
#: A heavier text than a shard is spread in parts of this part of a shard.
PART = 16
#: Nodes that are broadcast at most (about 100 bytes each).
FEW = 50_000
TEXT = ["h", "text_crc32", "size"]


def ranked(points: DataFrame, column: str, work: Workspace) -> DataFrame:
    """The different values of a column with their ranks by code point, null first; no partition sees more than its range."""
    values = points.select(F.col(column).alias("value")).distinct().orderBy(F.col("value").asc_nulls_first())
    values = work.write(values.select("value", F.monotonically_increasing_id().alias("place")), f"{column}_values")
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = values.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranks = values.withColumn("part", part).join(parts, "part")
    return ranks.select(F.col("value"), (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).cast("double").alias(f"p_{column}"))


def with_rank(points: DataFrame, column: str, work: Workspace) -> DataFrame:
    ranks = ranked(points, column, work)
    return points.join(ranks, points[column].eqNullSafe(ranks["value"])).drop("value", column)


def split_level(units: DataFrame, near) -> DataFrame:
    """units (first, shards, w, tie, c0, c1, ...) with every node of several shards split in two.

    A node is named by its first shard. Its widest dimension is split where the left side has the bytes of its shards; the
    hash after each coordinate keeps units from tying, so a value that holds a third of all bytes can be cut too. near
    marks a table of nodes for a join.
    """
    dims = range(len(DIMENSIONS))
    open_ = units.where("shards > 1")
    spans = open_.groupBy("first", "shards").agg(F.sum("w").alias("w"), *(F.array(*(f(f"c{d}") for d in dims)).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))))
    widths = F.zip_with("most", "least", lambda a, b: a - b)
    spans = spans.withColumn("dim", F.array_position(widths, F.array_max(widths)).cast("int"))
    end = lambda c: F.shiftleft(F.element_at(c, F.col("dim")), TIE)
    goal = F.col("w") * F.expr("shards div 2") / F.col("shards")
    found = spans.select("first", "dim", goal.alias("goal"), end("least").alias("low"), (end("most") + ((1 << TIE) - 1)).alias("high"), F.lit(0).cast("long").alias("below"))

    key = F.shiftleft(F.element_at(F.array(*(F.col(f"c{d}") for d in dims)), F.col("dim")), TIE) + F.col("tie")
    step = F.expr(f"(high - low) div {BINS} + 1")
    names = ["first", "dim", "goal", "low", "high", "below"]
    so_far = Window.partitionBy("first").orderBy("bin")
    for _ in range(PASSES):
        inside = open_.join(near(found.select(*names)), "first").withColumn("key", key).where("key between low and high")
        bins = inside.groupBy(*names, F.expr(f"(key - low) div ((high - low) div {BINS} + 1)").alias("bin")).agg(F.sum("w").alias("w"))
        bins = bins.withColumn("upto", F.col("below") + F.sum("w").over(so_far))
        # the first bin with which the left side reaches its goal
        bins = bins.where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("w") < F.col("goal")))
        start = F.col("low") + F.col("bin") * step
        found = bins.select("first", "dim", "goal", start.alias("low"), F.least("high", start + step - 1).alias("high"), (F.col("upto") - F.col("w")).alias("below"), "upto")
    # what the last bin holds goes to the side that it brings nearer its goal
    cut = F.when(F.col("upto") - F.col("goal") <= F.col("goal") - F.col("below"), F.col("high")).otherwise(F.col("low") - 1)
    placed = units.join(near(found.select("first", "dim", cut.alias("cut"))), "first", "left").withColumn("right", F.coalesce(key > F.col("cut"), F.lit(False)))
    half = F.expr("shards div 2")
    return placed.select(
        (F.col("first") + F.when(F.col("right"), half).otherwise(0)).cast("int").alias("first"),
        F.when(F.col("shards") == 1, 1).when(F.col("right"), F.col("shards") - half).otherwise(half).cast("int").alias("shards"),
        *(c for c in units.columns if c not in ("first", "shards")))


def coordinate(value: Column, low: float, high: float) -> Column:
    """An integer of BITS bits; null is the smallest."""
    scaled = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit((1 << BITS) - 2)).cast("long") if high > low else F.lit(0).cast("long")
    return F.coalesce(scaled + 1, F.lit(0).cast("long"))


def shard_by_tree(docs: DataFrame, work: Workspace, shards: int | None = SHARDS, target_bytes: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of docs (doc_id, text, lang, source).

    Give the number of shards, or the bytes that a shard should hold. Size is the text's UTF-8 bytes (null: none) plus 8.
    Null texts count as empty, null languages, sources and ids as smallest; ids that are no numbers are ordered by a hash.
    Repeated rows each get a slot. Documents with equal texts share a shard unless together they weigh more than a shard's
    target. Very long texts are single units, and a shard with one may exceed the target. A shard stays empty only if there
    are too few texts; an empty table gives an empty result; other columns are not read.
    """
    by_id = F.col("doc_id").cast("double") if isinstance(docs.schema["doc_id"].dataType, NumericType) else F.xxhash64("doc_id").cast("double")
    by_id = F.when(F.col("doc_id").isNotNull() & ~F.isnan(by_id) & (F.abs(by_id) < 1e300), by_id)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_of().alias("text")).select(
        "doc_id", "lang", "source", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("h"), by_id.alias("p_doc_id"), F.monotonically_increasing_id().alias("row"))
    rows = work.write(rows, "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = shards or max(1, -(-int(total) // int(target_bytes)))
    target = max(total / shards, 1)
    # fewer texts than shards can weigh more than one: a row for each shard at most
    heavy = rows.groupBy(*TEXT).agg(F.sum("size").alias("w")).where((F.col("w") > target) & (F.col("w") > F.col("size"))).select(*TEXT, F.ceil(F.col("w") / (target / PART)).alias("parts"))
    near = lambda nodes: F.broadcast(nodes) if shards <= FEW else nodes
    salted = rows.join(near(heavy), TEXT, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))).drop("parts")
    points = work.write(salted.groupBy(*TEXT, "salt").agg(F.sum("size").alias("w"), *(F.min(c).alias(c) for c in ("lang", "source", "p_doc_id"))), "points")
    for c in ("lang", "source"):
        points = with_rank(points, c, work)
    points = work.write(points.withColumn("p_size", F.log2("size")), "ranked")
    ends = points.agg(*(f(f"p_{d}").alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max))).first()
    places = [coordinate(F.col(f"p_{d}"), float(ends[f"min_{d}"] or 0), float(ends[f"max_{d}"] or 0)).alias(f"c{i}") for i, d in enumerate(DIMENSIONS)]
    units = points.select(F.lit(0).alias("first"), F.lit(shards).alias("shards"), *TEXT, "salt", "w", F.pmod(F.xxhash64(*TEXT, "salt"), F.lit(1 << TIE)).alias("tie"), *places)
    for level in range((shards - 1).bit_length()):
        # up to here the nodes double with every level
        units = work.write(split_level(units, F.broadcast if 2**level <= FEW else lambda nodes: nodes), "units")

    homes = units.select(*TEXT, "salt", F.col("first").alias("shard"))
    buckets = max(64, -(-n // (shards * SLOT_ROWS)))
    placed = salted.join(homes, [*TEXT, "salt"]).select("doc_id", "size", "text_crc32", "shard", "row", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket"))
    placed = work.write(placed, "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("here"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    # shard alone would satisfy the window, and put a whole shard in one task
    numbered = placed.repartition("shard", "bucket").withColumn("place", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")))
    return numbered.join(counts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))


def op3_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_tree(table(spark, sf_dir, "documents"), Workspace(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
