"""The corpus pipeline on a small table: every stage takes effect, and what is clean stays."""

import corpus_pipeline
from conftest import DATA

from mailstruct.llm.common import Workspace, table
from mailstruct.llm.mixing import words_of

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages(spark):
    work, docs, counts = Workspace(spark), table(spark, DATA, "documents"), []
    labels = {r.doc_id: r for r in table(spark, DATA, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [r.doc_id for r in docs.select("doc_id").collect()]
        docs = work.write(stage(spark, docs, DATA), name.replace(" ", "_"))
        assert docs.columns == COLUMNS
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= set(before)
        if name == "quality classifier":
            good = [i for i in before if i in labels and labels[i].quality == 1]
            assert len(set(good) & set(after)) >= 0.95 * len(good)
        counts.append(len(after))
    # the filters drop some rows, and near duplicates leave fewer
    assert 200 > counts[0] > counts[1] > counts[2] > 50
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert len({(p.doc_id, p.doc_row) for p in pieces}) == counts[-1]


def test_near_duplicates_leave_one_of_each_class(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "A b c d e f g", "en", "t", 1), (3, "other words are in this one", "en", None, 1), (None, "x", None, None, None), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rows string")
    got = corpus_pipeline.near_duplicate_stage(spark, docs, DATA).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 3, 4]


def test_rows_that_share_an_id_go_by_their_texts(spark):
    """Unlike texts of one id both stay; a text whose class has a smaller id goes, also if its id stands for another class."""
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(7, words("a")), (7, words("b")), (3, words("c")), (7, words("c") + " tail"), (7, words("a")), (9, words("b").upper()), (None, words("a")), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, DATA).collect()
    kept = sorted((r.doc_id or 0, r.text or "") for r in got)
    assert kept == sorted([(7, words("a")), (7, words("b")), (3, words("c")), (0, words("a")), (8, "")])
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where("false"), DATA).count() == 0


def test_mixing_repeats_and_drops(spark):
    rows = [(i, " ".join(["w"] * (i % 9 + 1)), "en", f"s{i % 3}", 0) for i in range(90)] + [(500, "same", "en", "s0", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixing_stage(spark, docs, DATA)
    total = sum(len(r[1].split()) for r in rows)
    mixed = got.select(words_of(got.text).alias("n")).agg({"n": "sum"}).first()[0]
    assert abs(mixed - 1.5 * total) <= 10 and got.columns == COLUMNS
    none = corpus_pipeline.mixing_stage(spark, docs.where("false"), DATA)
    assert none.count() == 0
