"""Near copies by rows: null ids, one id with several texts, repeated rows; the pipeline on them."""

import random

import corpus_pipeline
from kamishi.llm.near_dedup import near_duplicates, one_of_each

SCHEMA = "doc_id long, text string"


def prose(seed, n=60):
    r = random.Random(seed)
    return [f"w{r.randint(0, 10**6)}" for _ in range(n)]


def near(words):
    return " ".join([*words[:-1], "other"])


def test_nulls_do_not_bridge(spark):
    a, b = prose(1), prose(2)
    rows = [(5, " ".join(a)), (9, " ".join(b)), (None, near(a)), (None, near(b))]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(5, 5, True), (9, 9, True), (None, 5, False), (None, 9, False)}


def test_one_id_with_two_texts(spark):
    a, b = prose(3), prose(4)
    rows = [(1, " ".join(a)), (2, " ".join(a)), (2, " ".join(b)), (3, near(b))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False)]


def test_only_nulls(spark):
    a = prose(5)
    rows = [(None, " ".join(a)), (None, near(a)), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r.n_shingles > 0, r.component_id, r.kept) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=str) == [(False, None, True), (False, None, True), (True, None, False), (True, None, True)]
    assert one_of_each(docs).count() == 3


def test_pipeline_keeps_one_of_repeated_rows(spark, tmp_path):
    a, b, c, d = (" ".join(prose(s, 90)) for s in (6, 7, 8, 9))
    rows = [(1, a), (1, a), (None, b), (None, b), (None, c), (4, c), (None, near(d.split())), (5, d), (6, " ".join(prose(10, 90)))]
    full = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.drop_passages):
        docs = stage(spark, docs, str(tmp_path)).cache()
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        assert got == sorted([(1, a), (None, b), (4, c), (5, d), (6, rows[-1][1])], key=str)
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1, 4, 5, 6]
