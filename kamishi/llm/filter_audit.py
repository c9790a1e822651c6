"""Filter interaction audit: what each filter removes in every order of a filter cascade.

Each document has a mask with one bit per failed filter. A part (a value of source) is summed up by
three histograms over the masks: of all documents, of good and of toxic ones. With the histograms of many
parts stacked as rows, integer matrices of 2**m masks by m! * m (order, step) pairs give all outcomes by
one product each: kept, removed, redundant and unique. Only histograms reach that product.

A copy is a text equal to that of a smaller doc_id anywhere in the table (compared by SHA-256). The rows
of the least doc_id of each text are found by aggregation and marked by an equi-join on doc_id and
digest, so a text that a third of the rows share is no hot key.

Null text is empty and null source the part ''. A row with a null doc_id is never a copy, makes no other
row one and has no label. Rows that repeat an id and a text count each, and none is a copy of the other;
a label counts if any row of labels says so. Texts of any length are one row. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table, words_of


@dataclass(frozen=True)
class Filter:
    """A document fails where fails(metrics) is true; without fails, where it is a copy."""

    name: str
    fails: Callable[[dict[str, Column]], Column] | None = None


FILTERS = (
    Filter("A", lambda m: m["n_words"] < 50),
    Filter("B", lambda m: 100 * m["n_distinct"] < 65 * m["n_words"]),
    Filter("C", lambda m: 100 * m["n_upper"] > 5 * m["n_chars"]),
    Filter("D", lambda m: m["has_symbol"]),
    Filter("E"),
)
#: Parts whose outcomes are made together.
PARTS = 64


def _metrics() -> dict[str, Column]:
    """Over the columns t (a text) and ws (its words)."""
    t, ws = F.col("t"), F.col("ws")
    return {
        "n_words": F.size(ws), "n_distinct": F.size(F.array_distinct(ws)), "n_chars": F.char_length(t),
        "n_upper": F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z]", "")), "has_symbol": t.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, filters=FILTERS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, part and mask of every row: bit i is set where it fails the i-th filter."""
    scratch = scratch or Scratch()
    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    metrics = _metrics()
    measured = read.withColumn("ws", words_of(F.col("t"))).select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *[v.alias(k) for k, v in metrics.items()])
    bits = [F.when(f.fails({k: F.col(k) for k in metrics}), 1 << i).otherwise(0) for i, f in enumerate(filters) if f.fails]
    own = scratch.table(measured.select("doc_id", "part", "digest", sum(bits, F.lit(0)).alias("mask")), "masks")
    copy = sum(1 << i for i, f in enumerate(filters) if not f.fails)
    if not copy:
        return own.drop("digest")
    firsts = own.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = own.join(firsts, ["doc_id", "digest"], "left")
    is_copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return marked.select("doc_id", "part", (F.col("mask") + F.when(is_copy, copy).otherwise(0)).alias("mask"))


def histograms(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the number of documents, of good and of toxic ones."""
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    return masked.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


@dataclass(frozen=True)
class Incidence:
    """Which masks count for each pair (order, step), as integer matrices of masks by pairs."""

    orders: list[str]
    kept: np.ndarray
    removed: np.ndarray
    redundant: np.ndarray
    unique: np.ndarray
    owner: np.ndarray  # pairs by filters: whose step it is


def incidence(names: tuple[str, ...]) -> Incidence:
    m = len(names)
    orders = np.array(list(permutations(range(m))))
    bit = np.left_shift(1, orders)
    own, before = bit.ravel(), (np.cumsum(bit, axis=1) - bit).ravel()
    mask = np.arange(1 << m)[:, None]
    fails, gone = (mask & own) != 0, (mask & before) != 0
    counts = (~fails & ~gone, fails & ~gone, fails & gone, mask == own)
    return Incidence(["".join(names[i] for i in o) for o in orders], *(c.astype(np.int64) for c in counts), (orders.reshape(-1, 1) == np.arange(m)).astype(np.int64))


OUTCOME = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _product(names: tuple[str, ...]):
    def run(batches):
        x = incidence(names)
        m, pairs = len(names), x.kept.shape[1]
        order, step = np.repeat(np.array(x.orders, object), m), np.tile(np.arange(1, m + 1, dtype=np.int32), len(x.orders))
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS):
                part = batch.slice(lo, PARTS)
                held = part.column("rows")
                stacked = np.zeros((3, part.num_rows, 1 << m), np.int64)
                at = np.repeat(np.arange(part.num_rows), held.value_lengths().to_numpy())
                mask, *counts = (c.to_numpy() for c in held.flatten().flatten())
                for h, n in zip(stacked, counts, strict=True):
                    h[at, mask] = n
                n, good, toxic = stacked
                removed = n @ x.removed
                outcomes = (n @ x.kept, removed, n @ x.redundant, n @ x.unique, good @ x.removed, toxic @ x.removed, removed @ x.owner @ x.owner.T)
                cols = [part.column("part").take(pa.array(np.repeat(np.arange(part.num_rows), pairs))), pa.array(np.tile(order, part.num_rows)), pa.array(np.tile(step, part.num_rows))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(o.ravel()) for o in outcomes)], [c.split()[0] for c in OUTCOME.split(", ")])

    return run


def audit(docs: DataFrame, labels: DataFrame, filters=FILTERS) -> DataFrame:
    """Of each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (what the step's filter removes, summed over all orders)."""
    hist = histograms(masks(docs, filters), labels)
    parts = hist.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # 2**m rows at most
    return parts.mapInArrow(_product(tuple(f.name for f in filters)), OUTCOME)


def op13(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
m AS (
  SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
         + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
h AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31),
s AS (SELECT filter_order, k::INT AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, range(1, 6) AS r(k)),
r AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
