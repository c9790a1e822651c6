"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Each rule's cost (seconds of its own job above those of an empty one) and selectivity (share rejected)
are estimated on a bounded sample of rows, read from a few files and kept with their words, so that a job
holds nothing but the rule; the rules then run in falling order of rejection per cost. Words are split off
once for all rules, and a metric is computed only for texts that no earlier rule rejected. The order never changes the verdict, only which rule is credited and what it
costs; costs are taken as powers of two, and rules that tie keep the given order. Metrics asked for in
the result are computed for all rows, before the rules; rules over them alone cost nothing more. The
cascade is one CASE, whose branches Spark evaluates one by one until a rule rejects.

Null or empty text has no words and fails the length rule. Repeated rows get equal verdicts. A text of
any length is one row of array functions in one task. An empty table gives an empty result. Other
columns pass through, whatever their names; the result's own (the metrics, failed_rule, kept) are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, words_of

WINDOW = 5
#: Rows of the sample on which costs and selectivities are estimated, and files that they come from.
SAMPLE_ROWS, SAMPLE_FILES = 2000, 8


@dataclass(frozen=True)
class Rule:
    """A rule rejects a document where fails(metrics) is true; needs names the metrics it reads."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[dict[str, Column]], Column]


BASE = (
    Rule("too_short", ("n_words",), lambda m: m["n_words"] < 10),
    Rule("repetitive", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
)
EXTRA = (
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    Rule("word_length", ("n_words", "word_chars"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"])),
    Rule("bullets", ("n_lines", "n_bullets"), lambda m: 10 * m["n_bullets"] > 9 * m["n_lines"]),
    Rule("ellipses", ("n_lines", "n_ellipses"), lambda m: 10 * m["n_ellipses"] > 3 * m["n_lines"]),
    Rule("few_letters", ("n_words", "n_lettered"), lambda m: 10 * m["n_lettered"] < 7 * m["n_words"]),
    Rule("poor_vocabulary", ("n_words", "n_distinct_words"), lambda m: (m["n_words"] >= 100) & (10 * m["n_distinct_words"] < m["n_words"])),
    Rule("repeated_paragraphs", ("n_paragraphs", "n_dup_paragraphs"), lambda m: 10 * m["n_dup_paragraphs"] > 3 * m["n_paragraphs"]),
    Rule("top_pair", ("n_words", "n_top_pair"), lambda m: (m["n_words"] >= 50) & (100 * m["n_top_pair"] > 10 * m["n_words"])),
)
RULES = BASE + EXTRA
#: Prefix of the columns that exist only while rules run.
OWN = "_quality_"


TEXT, WORDS = OWN + "text", OWN + "words"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def _n_repeat_words(t: Column, w: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words. Only texts with a repeated hash go on to
    the sort by (hash, position), whose equal neighbours give the repeated windows.
    """
    at = lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)])
    hashes = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))
    same = lambda s, x, j: s[j]["h"] == x["h"]
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))

    def covered(s):
        twice = F.filter(s, lambda x, j: F.when(j > 0, same(s, x, F.greatest(j - 1, F.lit(0)))).otherwise(False) | F.when(j < F.size(s) - 1, same(s, x, F.least(j + 1, F.size(s) - 1))).otherwise(False))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), zero, step, lambda a: a["n"])

    def over(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(pairs, covered)).otherwise(0)

    return _let(hashes, over)


def _n_top_pair(t: Column, w: Column) -> Column:
    """Occurrences of the most frequent pair of neighbouring words: the longest run of sorted pair hashes."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(w[i], w[i + 1])))
    zero = F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(a, h):
        run = F.when(a["h"] == h, a["run"] + 1).otherwise(1)
        return F.struct(h.alias("h"), run.alias("run"), F.greatest(a["top"], run).alias("top"))

    return F.when(F.size(w) > 1, F.aggregate(pairs, zero, step, lambda a: a["top"])).otherwise(0)


def _repeated(parts: Column) -> Column:
    """Number of the parts with a word that equal an earlier one."""
    worded = F.filter(parts, lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return _let(worded, lambda p: F.size(p) - F.size(F.array_distinct(p)))


def _lines(t: Column) -> Column:
    return F.split(t, "\n")


def _count(parts: Column, holds) -> Column:
    return F.size(F.filter(parts, holds))


#: Each is an expression of a text and its words.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w),
    "word_chars": lambda t, w: F.char_length(F.array_join(w, "")),
    "n_symbols": lambda t, w: F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", "")),
    "n_lines": lambda t, w: F.size(_lines(t)),
    "n_dup_lines": lambda t, w: _repeated(_lines(t)),
    "n_repeat_words": _n_repeat_words,
    "n_bullets": lambda t, w: _count(_lines(t), lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ") | F.ltrim(x).startswith("•")),
    "n_ellipses": lambda t, w: _count(_lines(t), lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")),
    "n_lettered": lambda t, w: _count(w, lambda x: x.rlike(r"\p{L}")),
    "n_distinct_words": lambda t, w: F.size(F.array_distinct(w)),
    "n_paragraphs": lambda t, w: F.size(F.split(t, "\n\n")),
    "n_dup_paragraphs": lambda t, w: _repeated(F.split(t, "\n\n")),
    "n_top_pair": _n_top_pair,
}


def _prepared(df: DataFrame, report=()) -> DataFrame:
    """df with its text (null: empty), the text's words and the metrics of report, each with the prefix."""
    out = df.withColumn(TEXT, F.coalesce("text", F.lit(""))).withColumn(WORDS, words_of(F.col(TEXT)))
    return out.withColumns({OWN + name: METRICS[name](F.col(TEXT), F.col(WORDS)).cast("long") for name in report})


def _metrics(names, report) -> dict[str, Column]:
    """The named metrics over a prepared row."""
    return {name: F.col(OWN + name) if name in report else METRICS[name](F.col(TEXT), F.col(WORDS)) for name in names}


def add_metrics(docs: DataFrame, names=tuple(METRICS)) -> DataFrame:
    """docs with the named metrics of their texts as long columns."""
    return _prepared(docs, names).withColumns({name: F.col(OWN + name) for name in names}).drop(TEXT, WORDS, *[OWN + name for name in names])


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, n_files: int = SAMPLE_FILES) -> DataFrame:
    """text of about so many rows, the first of each split of some files spread over the table; no other
    file is read. A table that is no Parquet gives its first rows."""
    files = sorted(docs.inputFiles())
    if not files or not all(f.endswith(".parquet") for f in files):
        return docs.select("text").limit(rows)
    chosen = files[:: -(-len(files) // n_files)]
    each = [docs.sparkSession.read.parquet(f).select("text").limit(-(-rows // len(chosen))) for f in chosen]
    out = each[0]
    for one in each[1:]:
        out = out.union(one)
    return out


def _seconds(run, times: int = 2) -> tuple[float, object]:
    """The least time of some runs (the first compiles), and the last one's result."""
    took = []
    for _ in range(times):
        began = time.monotonic()
        out = run()
        took.append(time.monotonic() - began)
    return min(took), out


def estimate(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, report: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) of each rule on a sample of about sample_rows rows, where words and
    the metrics of report are there already."""
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    sample = _prepared(sample_of(docs, sample_rows).repartition(tasks), report).cache()
    try:
        rows = sample.count()
        if not rows:
            return [(r, 1.0, 0.0) for r in rules]
        empty, _ = _seconds(lambda: sample.agg(F.count_if((F.col(TEXT) == "-") | (F.size(WORDS) < 0))).first())
        out = []
        for rule in rules:
            job = sample.agg(F.count_if(rule.fails(_metrics(rule.needs, report))))
            took, row = _seconds(lambda job=job: job.first())
            out.append((rule, max(took - empty, 1e-3), row[0] / rows))
        return out
    finally:
        sample.unpersist()


def order_rules(estimates) -> list[Rule]:
    """Falling rejection per cost (to a power of two); ties keep the given order."""
    return [r for r, cost, share in sorted(estimates, key=lambda x: -x[2] / 2.0 ** round(np.log2(x[1])))]


def quality_filter(docs: DataFrame, rules=RULES, order: list[Rule] | None = None, report: tuple[str, ...] = ()) -> DataFrame:
    """docs with failed_rule, kept and the metrics of report; rules in the estimated order unless one is given."""
    order = order or order_rules(estimate(docs, rules, report=report))
    failed = F.lit(None).cast("string")
    for rule in reversed(order):
        failed = F.when(rule.fails(_metrics(rule.needs, report)), rule.name).otherwise(failed)
    # a condition on the verdict must stay above the rules: pushed below, it would hold all of them over again
    out = _prepared(docs, report).withColumn(OWN + "failed", F.when(F.rand(0) >= 0, failed))
    out = out.withColumns({"failed_rule": F.col(OWN + "failed"), "kept": F.col(OWN + "failed").isNull(), **{k: F.col(OWN + k) for k in report}})
    return out.drop(TEXT, WORDS, OWN + "failed", *[OWN + k for k in report])


REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [*BASE, *order_rules(estimate(docs, EXTRA, report=REPORTED))]
    judged = quality_filter(docs, order=order, report=REPORTED)
    m = {k: F.col(k) for k in REPORTED}
    return judged.select("doc_id", *REPORTED, (BASE[0].fails(m) | BASE[1].fails(m)).alias("base_failed"), "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
wins AS (
  SELECT doc_id, unnest(range(0, greatest(len(ws) - 4, 0))) AS i, ws FROM w),
grams AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM wins),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
cover AS (
  SELECT grams.doc_id, count(DISTINCT i + k)::BIGINT AS n
  FROM grams JOIN twice ON grams.doc_id = twice.doc_id AND grams.g = twice.g, range(0, 5) AS r(k)
  GROUP BY grams.doc_id),
worded AS (
  SELECT doc_id, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, string_split(t, chr(10) || chr(10)) AS ps FROM w),
lw AS (SELECT *, list_filter(ps, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wps FROM worded),
pairs AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)),
top AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM pairs GROUP BY doc_id, g) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lw.ls) - len(list_distinct(lw.ls)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(w.ls) AS n_lines,
         len(list_filter(w.ls, lambda x: starts_with(ltrim(x, ' '), '- ') OR starts_with(ltrim(x, ' '), '* ') OR starts_with(ltrim(x, ' '), '•'))) AS n_bullets,
         len(list_filter(w.ls, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…'))) AS n_ellipses,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered, len(list_distinct(ws)) AS n_distinct,
         len(lw.ps) AS n_paragraphs, len(lw.wps) - len(list_distinct(lw.wps)) AS n_dup_paragraphs, coalesce(top.n, 0) AS n_top_pair
  FROM w JOIN lw ON w.doc_id = lw.doc_id LEFT JOIN cover ON w.doc_id = cover.doc_id LEFT JOIN top ON w.doc_id = top.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines
            OR 10 * n_lettered < 7 * n_words OR (n_words >= 100 AND 10 * n_distinct < n_words) OR 10 * n_dup_paragraphs > 3 * n_paragraphs
            OR (n_words >= 50 AND 100 * n_top_pair > 10 * n_words)) AS kept
FROM f
"""
