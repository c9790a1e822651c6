"""The pipeline stage by stage: clashing columns, planted passages, clean documents, copies."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from kamishi.llm import line_dedup, suffix_dedup

CLASHING = ["_b", "group", "r1", "r2", "dropped", "lines", "gone", "n_lines", "n_dropped", "kept_text", "n_units", "n_removed", "kept", "score", "lang_pred", "foreign", "row", "name", "shard", "payload", "node", "comp", "key"]


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 8))) for _ in range(n))


def corpus():
    passage, line = prose(1000, 55), prose(1001, 12)
    rows = [(i, prose(i) + "\n" + line) for i in range(15)]
    rows += [(20 + i, prose(100 + i, 60) + " " + passage + " " + prose(200 + i, 60)) for i in range(3)]
    rows += [(30, prose(300)), (31, prose(300) + " end"), (40, None), (41, ""), (42, "1234 5678"), (None, prose(400)), (None, prose(401)), (50, prose(500) + " ñandú " * 3)]
    return passage, line, rows


def test_stages(spark, tmp_path):
    passage, line, rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    full = [(i, t, "xx", "s", len(t or ""), *CLASHING) for i, t in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = dict(rows)
    nulls = [t for i, t in rows if i is None]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path)).cache()
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all([r[c] for c in CLASHING] == CLASHING and r.lang == "xx" and r.n_chars == len(r.text) for r in got), name
        if name == "language_id":
            assert {r.doc_id for r in got} == set(left) - {40, 41, 42}
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in got if r.doc_id is not None and r.doc_id < 15} == {i: prose(i) + ("\n" + line if i == 0 else "") for i in range(15)}
        if name == "minhash_near_dedup":
            assert {r.doc_id for r in got} == set(left) - {40, 41, 42, 31}
        docs = out
    final = {r.doc_id: r.text for r in got if r.doc_id is not None}
    assert all(passage not in t for t in final.values()) and all(final[20 + i].startswith(prose(100 + i, 60)) for i in range(3))
    assert final[30] == left[30] and final[50] == left[50] and sorted(r.text for r in got if r.doc_id is None) == sorted(nulls)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in packed}) == sorted({-1, *final})


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "x y z\n" + prose(7, 100), *CLASHING) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))
    done = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs, min_docs=2)).collect()
    own = {"n_lines": 2, "n_dropped": 2, "kept_text": ""}
    assert all({c: r[c] for c in CLASHING} == {c: own.get(c, c) for c in CLASHING} for r in done) and len(done) == 3
    done = suffix_dedup.dedup_suffixes(docs).select(*[c for c in CLASHING if c not in ("n_units", "n_removed", "kept")], F.col("n_removed")).collect()
    assert all(r[c] == c for r in done for c in CLASHING if c not in ("n_units", "n_removed", "kept")) and all(r.n_removed > 400 for r in done)
