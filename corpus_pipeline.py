"""From raw documents to packed training sequences: five stages, each by one of the training-data operators.

Every stage works on all that the stage before kept, and all but the last return the columns of documents. Training
stages learn from labelled rows of their own input outside the held-out fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mailstruct.llm import mixing, near_duplicates, packing, rules, toxicity
from mailstruct.llm.common import Workspace, release, table, text_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rule ensemble predicts to be of label 0."""
    docs = docs.select(*COLUMNS)
    model = rules.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rules.score(docs, model).where("predicted = 1").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the nearest labelled examples predict to be toxic."""
    docs = docs.select(*COLUMNS)
    work = Workspace(spark)
    index = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), work)
    work.clear()
    kept = toxicity.score(docs, index).where("predicted = 0").select(*COLUMNS)
    # the broadcast holds the index now; the driver's copy would stay through all later stages
    del index
    release()
    return kept


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates: that with the smallest id, and of rows that share it one of that class's texts.

    Rows with one id and unlike texts belong to classes of their own, and each class keeps one. Rows without an id all stay. Null texts
    count as empty, and empty texts are copies of each other; repeated rows leave one. An empty table stays empty; columns other than those of
    documents go.
    """
    table(spark, sf_dir, "documents")
    docs = docs.select(*COLUMNS)
    work = Workspace(spark)
    # where rows share ids, a row goes by its id and its text's digest
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count()
    docs = docs.withColumn("mark", F.struct("doc_id", F.sha2(text_of(), 256).alias("digest")) if ids else F.col("doc_id"))
    found = near_duplicates.near_duplicates(docs.where("doc_id is not null").select(F.col("mark").alias("doc_id"), "text"), work)
    keep = Workspace(spark).write(found.where("doc_id = class_id").select(F.col("doc_id").alias("mark")).distinct(), "keep")
    work.clear()
    kept = docs.where("doc_id is not null").join(keep.hint("merge"), "mark", "left_semi")
    if ids:
        kept = kept.dropDuplicates(["mark"])
    return kept.select(*COLUMNS).unionAll(docs.where("doc_id is null").select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; documents that it doesn't take go."""
    table(spark, sf_dir, "documents")
    docs = docs.select(*COLUMNS)
    work = Workspace(spark)
    mixed = mixing.mix(docs.select("doc_id", "text", "source"), work)
    # rows that agree in id, source and size share their epochs, as evenly as they go; keys without nulls let one shuffle do
    key = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(f"key_{c}") for c in ("doc_id", "source", "size")]
    names = [f"key_{c}" for c in ("doc_id", "source", "size")]
    epochs = mixed.groupBy(*key, F.col("doc_id").isNull().alias("no_id"), F.col("source").isNull().alias("no_source")).agg(F.sum("epochs").alias("epochs"), F.count("*").alias("alike")).where("epochs > 0")
    epochs = Workspace(spark).write(epochs, "epochs")
    work.clear()
    names += ["no_id", "no_source"]
    sized = docs.withColumn("size", mixing.words_of(text_of())).select(*COLUMNS, *key, F.col("doc_id").isNull().alias("no_id"), F.col("source").isNull().alias("no_source"))
    joined = sized.join(epochs.hint("merge"), names)
    place = F.lit(1)
    if epochs.where("alike > 1").limit(1).count():
        place = F.row_number().over(Window.partitionBy(*names).orderBy("n_chars", "lang"))
    times = F.expr("cast(epochs div alike + if(place <= epochs % alike, 1, 0) as int)")
    times = joined.withColumn("place", place).select(*COLUMNS, times.alias("times")).where("times > 0")
    return times.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into windows of several context sizes; one row for each piece."""
    table(spark, sf_dir, "documents")
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    work = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
