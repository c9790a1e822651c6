"""The pipeline's first stage: texts in no learned language go, all others stay."""

import corpus_pipeline

FOREIGN = [
    "Это простое предложение на русском языке", "Αυτή είναι μια απλή πρόταση", "这是一个简单的句子", "これは簡単な文です", "To jest proste zdanie w języku polskim, które nie powinno tu zostać",
    "Bu basit bir Türkçe cümledir ve burada kalmamalıdır", "Tämä on yksinkertainen suomenkielinen lause joka ei kuulu tähän", "xqzv kjwq pfgh zzkt wvxq bnmk qjxz lkjh",
]
CLEAN = ["the report was written by the council and it was sent to the people", "der Bericht wurde von dem Rat geschrieben und an die Leute geschickt", "le rapport a été écrit par le conseil"]


def test_foreign_texts_go(spark):
    learned = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = [(10**9 + i, t, None) for i, t in enumerate(FOREIGN + CLEAN)]
    docs = learned.unionByName(spark.createDataFrame([*more, (10**9 + 99, "12 %", None), (10**9 + 100, None, None)], "doc_id long, text string, lang string"))
    left = {r.doc_id: r.text for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    lettered = {r.doc_id for r in learned.collect() if any(c.isalpha() for c in r.text or "")}
    assert {d for d in left if d < 10**9} == lettered
    assert [t for d, t in left.items() if d >= 10**9 and t not in CLEAN] == [] and len(left) == len(lettered) + len(CLEAN)
