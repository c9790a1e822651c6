"""The corpus pipeline: language ID, line dedup, near-dedup, suffix-array dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
to the shared folder, reads it again for the next and then deletes it. All but the last return the
columns of documents, with whatever others docs has; a text that a stage changes gets its n_chars
anew, and nothing else is touched. ORACLE_SQL is None: a trained classifier is not SQL.

Null and empty texts go with the language ID (no letter to judge); rows with null or equal ids are
rows like any other; equal rows are copies, of which one stays; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kamishi.llm import langid, line_dedup, near_dedup, packing, suffix_dedup
from kamishi.llm.common import Scratch

#: Texts whose language is less certain than this go, as do texts without a letter.
MIN_SCORE = 0.15
#: Bytes and grams of a repeated passage: more than 50 words of four letters or so.
PASSAGE, PASSAGE_GRAM = 240, 24
#: Bytes of rows that a stage hands its Python workers at once (Spark's own default is 64 MB).
BATCH_BYTES = 4 << 20


def _small_batches(spark) -> None:
    """For the session from here on: stages are evaluated after they return."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as one column, so that no column clashes with an operator's own."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def _rows(done: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The rows with their columns of docs; text and n_chars anew where changed."""
    anew = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*[F.when(changed, anew[c]).otherwise(F.col("row")[c]).alias(c) if c in anew else F.col("row")[c].alias(c) for c in docs.columns])


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay; those in a script that none uses, or too unlike all training texts, go."""
    _small_batches(spark)
    model = langid.train(docs)
    names = [c if c == "text" else f"column{i}" for i, c in enumerate(docs.columns)]  # that no column clashes with the operator's own
    judged = langid.identify(docs.toDF(*names), model, floor=langid.floors(docs, model))
    return judged.where((F.col("lang_pred") != langid.UNSEEN) & (F.col("score") >= MIN_SCORE) & ~F.col("foreign")).select(*names).toDF(*docs.columns)


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a line found in ten or more documents only the first occurrence stays."""
    done = line_dedup.apply_bitmaps(_carried(docs), line_dedup.line_bitmaps(docs, keep_first=True))
    return _rows(done, docs, F.col("kept_text"), F.col("n_dropped") > 0)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays, whatever the ids."""
    return near_dedup.one_of_each(docs, size=5)


def drop_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of PASSAGE bytes found in two places go; half characters at their ends go with them."""
    _small_batches(spark)
    done = suffix_dedup.dedup_suffixes(_carried(docs), PASSAGE, PASSAGE_GRAM)
    kept = F.col("kept").cast("string")
    whole = F.when(F.is_valid_utf8(kept), kept).otherwise(F.replace(F.make_valid_utf8(kept), F.lit("�"), F.lit("")))
    return _rows(done, docs, whole, F.col("n_removed") > 0)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_passages),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch()
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.discard(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
