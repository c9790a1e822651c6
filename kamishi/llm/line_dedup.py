"""Line dedup: hashed lines, range-partitioned with a secondary sort, answered by keep bitmaps.

A line's key is the line with white space stripped at both ends and A-Z lower-cased; a key is
compared by two 64-bit hashes. Lines of fewer than min_chars code points are never dropped. Null or
empty text is one empty line. Rows equal in id and text count as one document and get the same
answer; a null id is an id like any other. A text of any length is one row; its lines are dealt out one
by one. A key held by many documents is spread by a salt where it is counted; where its documents learn
of it the keys are broadcast if they are few, else Spark's skew join splits them. An empty table gives an
empty result. Columns besides doc_id and text are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialize, row_key, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(SPACE_CHARS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = rows.select("doc_id", "r1", "r2", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("doc_id", "r1", "r2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))


def _in_key_order(lines: DataFrame) -> tuple[DataFrame, list[str]]:
    """Lines range-partitioned by key and salt, each run sorted by document and position.

    The salt is a function of the document, so a hot key spreads over as many ranges as there are
    shuffle partitions while all its lines of one document stay together.
    """
    salts = max(8, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    run = ["h1", "h2", "salt"]
    salted = lines.withColumn("salt", F.pmod("r1", F.lit(salts)))
    return salted.repartitionByRange(salts, *run).sortWithinPartitions(*run, "doc_id", "r1", "r2", "pos"), run


def key_statistics(lines: DataFrame) -> DataFrame:
    """Of each key: the number of documents and its first line (document, position)."""
    ordered, run = _in_key_order(lines)
    w = Window.partitionBy(*run).orderBy("doc_id", "r1", "r2", "pos")
    earlier = F.lag(F.struct("r1", "r2")).over(w)
    first_in_doc = earlier.isNull() | (earlier != F.struct("r1", "r2"))
    firsts = ordered.withColumn("opens", first_in_doc).where("opens")
    per_run = firsts.groupBy(*run).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "r1", "r2", "pos")).alias("first"))
    return per_run.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Per document (r1, r2) with a dropped line: its dropped lines as sparse 64-bit bitmap words.

    Keys found in at least min_docs documents lose all their lines; with keep_first the first line
    (smallest document, then position) of such a key stays. min_docs=1 with keep_first is plain
    first-occurrence dedup.
    """
    lines = materialize(_hashed_lines(docs, min_chars), "lines")
    drop = materialize(key_statistics(lines).where(F.col("n_docs") >= min_docs), "line-keys")
    hit = lines.join(drop, ["h1", "h2"])
    if keep_first:
        hit = hit.where(F.struct("r1", "r2", "pos") != F.struct("first.r1", "first.r2", "first.pos"))
    bits = hit.groupBy("r1", "r2", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return bits.groupBy("r1", "r2").agg(F.collect_list(F.struct("word", "bits")).alias("dropped"))


def _positions(words: Column) -> Column:
    """Line numbers set in the bitmap words."""
    return F.flatten(F.transform(words, lambda w: F.filter(F.sequence(w["word"] * 64, w["word"] * 64 + 63), lambda p: F.getbit(w["bits"], p % 64) == 1)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text (columns of these names are replaced); the others stay as they are."""
    r1, r2, dropped, lines, gone, key1, key2 = unused(docs, "r1", "r2", "dropped", "lines", "gone", "key1", "key2")
    marked = docs.withColumns(dict(zip((r1, r2), row_key(F.col("doc_id"), F.col("text")), strict=True)))
    found = bitmaps.select(F.col("r1").alias(key1), F.col("r2").alias(key2), F.col("dropped").alias(dropped))
    joined = marked.join(found, (F.col(r1) == F.col(key1)) & (F.col(r2) == F.col(key2)), "left").withColumn(lines, lines_of(F.col("text")))
    judged = joined.withColumn(gone, F.when(F.col(dropped).isNotNull(), _positions(F.col(dropped))))
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    return judged.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col(gone).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(keep, lambda i: F.col(lines)[i]), "\n")),
    }).drop(r1, r2, key1, key2, lines, gone, dropped)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of each document."""
    docs = docs.select("doc_id", "text")
    return apply_bitmaps(docs, line_bitmaps(docs, min_docs, min_chars, keep_first))


def op7(spark, sf_dir):
    from .common import table

    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
bad AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(bad.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN bad ON keyed.k = bad.k GROUP BY doc_id
"""
