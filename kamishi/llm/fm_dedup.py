"""Substring dedup: windows of words that also start in a document with a smaller id.

Each shard holds a compressed FM-index over the word ids of its contexts: a wavelet matrix of
bit-packed levels with block ranks over the Burrows-Wheeler transform. Contexts are streamed against
it by backward search, all positions at once; a position's matching statistic is the longest match
ending there whose suffix range reaches a smaller document (a range-minimum query over the suffixes'
documents). Positions whose statistic reaches the window length give the reported intervals.

Words are compared by 64-bit hashes. Null text has no words; texts shorter than the window keep
everything; rows with one id are one document, a null id counts as larger than all others; an empty
table gives an empty result; columns besides doc_id and text pass through (those named n_units, n_removed, n_spans or kept are replaced).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchored import SMALLER, Contexts, Spec, remove_repeats
from .common import table

WINDOW, GRAM = 13, 3
NONE = np.empty(0, np.int64)


class WaveletMatrix:
    """rank(c, i): how often c occurs in the first i symbols. Levels are packed to 64-bit words."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        n = len(symbols)
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.packbits(np.append(ones, np.zeros(-n % 64 + 64, bool)), bitorder="little").view(np.uint64)
            blocks = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.levels.append((bit, packed, blocks, n - int(ones.sum())))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, c: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        start, ends = np.zeros(len(c), np.int64), list(ends)
        for bit, packed, blocks, zeros in self.levels:
            one = (c >> bit & 1).astype(bool)
            for k, i in enumerate([start, *ends]):
                below = packed[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
                r = blocks[i >> 6] + np.bitwise_count(below)
                at = np.where(one, zeros + r, i - r)
                if k:
                    ends[k - 1] = at
                else:
                    start = at
        return [e - start for e in ends]


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """By prefix doubling; ends as soon as all ranks differ."""
    n, k = len(ranks), 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = ranks[k:]
        order = np.lexsort((second, ranks))
        new = (ranks[order][1:] != ranks[order][:-1]) | (second[order][1:] != second[order][:-1])
        ranks = np.empty(n, np.int64)
        ranks[order] = np.concatenate(([0], np.cumsum(new)))
        if ranks[order[-1]] == n - 1 or k >= n:
            return order
        k *= 2


class FMIndex:
    """Over texts of symbols 1.. that are separated by 0; labels give the least document of a range."""

    def __init__(self, texts: np.ndarray, breaks: np.ndarray, labels: np.ndarray, sigma: int):
        ranks = texts + len(breaks)
        ranks[breaks] = np.arange(len(breaks))  # separators differ, so suffixes never run into the next text
        sa = suffix_array(ranks)
        self.n = len(sa)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(texts, minlength=sigma))))
        self.bwt = WaveletMatrix(texts[sa - 1], sigma)
        self.least = [labels[sa]]
        while 2 << len(self.least) - 1 <= self.n:
            half, row = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(row[:-half], row[half:]))

    def least_in(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << k)])
        return out

    def matching_statistics(self, query: np.ndarray, ends: np.ndarray, floor: np.ndarray, own: np.ndarray, cap: int) -> np.ndarray:
        """Of each end: the longest match (up to cap) that ends there, starts at floor or later and
        occurs in a document below own."""
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        for step in range(cap):
            at = ends[live] - step
            keep = at >= floor[live]
            live, lo, hi, at = live[keep], lo[keep], hi[keep], at[keep]
            if not len(live):
                break
            c = query[at]
            rl, rh = self.bwt.rank(c, lo, hi)
            lo, hi = self.starts[c] + rl, self.starts[c] + rh
            keep = lo < hi
            live, lo, hi = live[keep], lo[keep], hi[keep]
            keep = self.least_in(lo, hi) < own[live]
            live, lo, hi = live[keep], lo[keep], hi[keep]
            length[live] = step + 1
        return length


def compare(spec: Spec, c: Contexts):
    """Ranges (context, start, end relative to its anchor) found in a smaller document of the shard."""
    n = len(c.key)
    lens = np.diff(c.at)
    _, ids = np.unique(c.units, return_inverse=True)
    texts = np.zeros(len(ids) + n, np.int64)
    breaks = c.at[1:] + np.arange(n)
    begin = c.at[:-1] + np.arange(n)
    word_at = np.arange(len(ids)) + np.repeat(np.arange(n), lens)
    texts[word_at] = ids + 1
    labels = np.repeat(c.val, lens + 1)
    index = FMIndex(texts, breaks, labels, int(ids.max(initial=0)) + 2)
    per = np.maximum(lens - spec.window + 1, 0)
    who = np.repeat(np.arange(n), per)
    start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    ends = begin[who] + start + spec.window - 1
    stats = index.matching_statistics(texts, ends, begin[who], c.val[who], spec.window)
    hit = stats >= spec.window
    return who[hit], (start - c.left[who])[hit], (start - c.left[who])[hit] + spec.window


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = 4096) -> DataFrame:
    """docs with n_units (words), n_removed, n_spans and kept, the remaining words joined by a space."""
    return remove_repeats(docs, Spec(window, gram, True, SMALLER, compare, hot))


def op4(spark, sf_dir):
    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
wins AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 12, 0))) AS i FROM d),
grams AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 13], ' ') AS g FROM wins),
least AS (SELECT g, min(doc_id) AS first_doc FROM grams GROUP BY g),
hit AS (SELECT DISTINCT doc_id, i + k AS pos FROM grams JOIN least USING (g), range(0, 13) AS r(k) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d),
marked AS (SELECT words.doc_id, word, words.pos, hit.pos IS NOT NULL AS gone FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id AND words.pos = hit.pos),
done AS (
  SELECT doc_id, count(*) FILTER (WHERE gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN done ON d.doc_id = done.doc_id
"""
