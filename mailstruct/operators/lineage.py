"""Hierarchies of any depth: the ancestors of layers, and redirects to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailstruct.plans.scratch import Scratch

#: Levels that the recursion may take; a mail's own depth is limited far below.
LEVELS = 1000

ANCESTRY = """
WITH RECURSIVE up(email_id, layer_seq, ancestor_seq, distance, path) MAX RECURSION LEVEL {levels} AS (
  SELECT email_id, layer_seq, parent_layer_seq, 1, array(layer_seq, parent_layer_seq) FROM {{layers}} WHERE parent_layer_seq < layer_seq
  UNION ALL
  SELECT up.email_id, up.layer_seq, l.parent_layer_seq, up.distance + 1, array_append(up.path, l.parent_layer_seq)
  FROM up JOIN {{layers}} l ON l.email_id = up.email_id AND l.layer_seq = up.ancestor_seq WHERE l.parent_layer_seq < l.layer_seq
) SELECT * FROM up
"""


def ancestry(layers: DataFrame) -> DataFrame:
    """(email_id, layer_seq, ancestor_seq, distance, path): every layer above a layer, and the way to it, from layers (email_id, layer_seq,
    parent_layer_seq). Layers have one row each. A layer without a parent has no row here.

    A layer's parent comes before it; a number that doesn't is no parent, so there are no circles. Deeper than LEVELS is an error.
    """
    spark = layers.sparkSession
    # else a million rows would end it
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    own = layers.select(F.col("email_id").cast("long").alias("email_id"), F.col("layer_seq").cast("int").alias("layer_seq"), F.col("parent_layer_seq").cast("int").alias("parent_layer_seq"))
    return spark.sql(ANCESTRY.format(levels=LEVELS), layers=own)


def whole_paths(layers: DataFrame) -> DataFrame:
    """(email_id, layer_seq, root_seq, depth, path): each layer's way from its outermost layer, itself included; of any depth."""
    longest = ancestry(layers).groupBy("email_id", "layer_seq").agg(F.max_by(F.struct("ancestor_seq", "distance", "path"), "distance").alias("a"))
    out = layers.select("email_id", "layer_seq").join(longest, ["email_id", "layer_seq"], "left")
    alone = F.array(F.col("layer_seq").cast("int"))
    return out.select("email_id", "layer_seq", F.coalesce("a.ancestor_seq", F.col("layer_seq").cast("int")).alias("root_seq"), F.coalesce("a.distance", F.lit(0)).alias("depth"), F.coalesce(F.reverse("a.path"), alone).alias("path"))


def redirects(known: DataFrame, work: Scratch, most: int = 10) -> DataFrame:
    """(short, final, hops, status) of each link of known (short, long): where its redirects end.

    status: `ok`; `too_many` for more hops than most, as a client gives up; `loop` where they never end, with null final and hops. By
    pointer jumping: each round doubles every link's jump, so the number of joins is the logarithm of the longest chain. A round in which no more
    links come to an end proves that the rest go round in circles. Links without a target, or that are their own, are ends; of
    several targets the smallest counts.
    """
    first = known.where("short is not null and long is not null and short <> long").groupBy("short").agg(F.min("long").alias("final"))
    state, left, number = work.write(first.select("short", "final", F.lit(1).cast("long").alias("hops"), F.lit(False).alias("ended")), "redirects-0"), None, 0
    while True:
        open_links = state.where("not ended")
        n = open_links.count()
        if n == 0 or n == left:
            break
        left, number = n, number + 1
        after = state.select(F.col("short").alias("final"), F.col("final").alias("next"), F.col("hops").alias("more"), F.col("ended").alias("next_ended"))
        jumped = open_links.join(after, "final", "left").select("short", F.coalesce("next", "final").alias("final"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("next_ended", F.lit(True)).alias("ended"))
        state = work.write(state.where("ended").unionAll(jumped), f"redirects-{number}")
    status = F.when(~F.col("ended"), "loop").when(F.col("hops") > most, "too_many").otherwise("ok")
    return state.select("short", F.when(F.col("ended"), F.col("final")).alias("final"), F.when(F.col("ended"), F.col("hops")).alias("hops"), status.alias("status"))


def expand_to_end(urls: DataFrame, known: DataFrame, work: Scratch, most: int = 10) -> DataFrame:
    """urls (original_url, is_shortened, ...) with expanded_url, hops and redirect_status; only shortened links are looked up.

    'Not Applicable' for a link that stays as it is, goes round in circles, or has too many redirects. No link is fetched.
    """
    ends = redirects(known, work, most)
    found = urls.drop("expanded_url").join(ends, (F.col("original_url") == F.col("short")) & F.col("is_shortened"), "left")
    final = F.when(F.col("status") == "ok", F.col("final")).otherwise(F.lit("Not Applicable"))
    return found.withColumn("expanded_url", final).withColumn("redirect_status", F.col("status")).drop("short", "final", "status")
