"""Suffix-array dedup: byte strings of `window` bytes that start in two or more places.

Contexts that share an anchor are sorted by their suffixes from the anchor. A comparison finds the
common extension of two suffixes by binary search over prefix polynomial hashes, so it takes a
logarithmic number of steps; the mergesort ranks all elements of all runs at once. Extensions to the
left are found the same way. Joining suffixes in falling order of their common extension, smaller set
into larger one, each new neighbour in left order gives the pairs whose extensions cover all shared
windows: n log n pairs instead of all. Every pair used is verified byte by byte.

Null text is empty; texts shorter than the window keep everything; rows with equal ids or texts are
separate texts, so a repeated row loses every window; an empty table gives an empty result; columns
besides doc_id and text pass through (those named n_units, n_removed, n_spans or kept are replaced).
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesvec as bv
from .anchored import ELSEWHERE, Contexts, Spec, remove_repeats
from .common import table

WINDOW, GRAM = 400, 40


class Extensions:
    """Common extensions of suffixes and prefixes at given places of a buffer."""

    def __init__(self, units: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.units, self.place, self.lo, self.hi = units, place, lo, hi
        self.sums = bv.byte_prefix(units)
        self.inverse = bv.powers(len(self.sums), "inverse")

    def limit(self, x, y, right):
        room = self.hi - self.place if right else self.place - self.lo
        return np.minimum(room[x], room[y])

    def common(self, x, y, right=True):
        """Longest m such that the m units after (before) the places of x and y have equal hashes."""
        low, high = np.zeros(len(x), np.int64), self.limit(x, y, right)
        px, py = self.place[x], self.place[y]
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) // 2
            if right:
                hx = (self.sums[px + mid] - self.sums[px]) * self.inverse[px]
                hy = (self.sums[py + mid] - self.sums[py]) * self.inverse[py]
            else:
                hx = (self.sums[px] - self.sums[px - mid]) * self.inverse[px - mid]
                hy = (self.sums[py] - self.sums[py - mid]) * self.inverse[py - mid]
            same = hx == hy
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def less(self, x, y, right=True):
        """Whether x sorts before y; a suffix that ends is least, ties go by number."""
        m = self.common(x, y, right)
        room = self.hi - self.place if right else self.place - self.lo
        ends = (m >= room[x]) | (m >= room[y])
        step = m if right else -m - 1
        last = len(self.units) - 1
        ux, uy = self.units[np.clip(self.place[x] + step, 0, last)], self.units[np.clip(self.place[y] + step, 0, last)]
        by_end = np.where(room[x] != room[y], room[x] < room[y], x < y)
        return np.where(ends, by_end, ux < uy)

    def exact(self, x: int, y: int, right=True) -> int:
        """The common extension by direct comparison, for the pair whose hashes collide."""
        n = int(self.limit(np.array([x]), np.array([y]), right)[0])
        p, q = int(self.place[x]), int(self.place[y])
        a = self.units[p : p + n] if right else self.units[p - n : p][::-1]
        b = self.units[q : q + n] if right else self.units[q - n : q][::-1]
        differ = np.flatnonzero(a != b)
        return int(differ[0]) if len(differ) else n


def merge_sort(group: np.ndarray, less) -> np.ndarray:
    """Positions sorted within groups (given in group order), by merging runs of doubling width."""
    n = len(group)
    perm = np.arange(n)
    opens = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.empty(0, np.int64)
    size = np.diff(np.append(opens, n))
    start, size = np.repeat(opens, size), np.repeat(size, size)
    place = np.arange(n) - start
    width, widest = 1, int(size.max(initial=0))
    while width < widest:
        run = place // width
        sib = (run ^ 1) * width
        length = np.clip(size - sib, 0, width)
        act = np.flatnonzero((length > 0) & (size > width))
        lo, hi = np.zeros(len(act), np.int64), length[act].copy()
        base, item = start[act] + sib[act], perm[act]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            other, own = perm[base[open_] + mid], item[open_]
            before = less(other, own)  # order is total, so one comparison serves both sides
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        to = start[act] + np.minimum(run[act], run[act] ^ 1) * width + place[act] - run[act] * width + lo
        new = perm.copy()
        new[to] = item
        perm, width = new, width * 2
    return perm


def shared_pairs(order, right_common, left_rank):
    """(x, y, right extension) triples of one group whose extensions cover all its shared windows.

    order: members by suffix; right_common: common extensions of neighbours in it; left_rank: a
    member's rank by left context.
    """
    n = len(order)
    parent = list(range(n))
    sets = [[(left_rank[m], m)] for m in order]

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in sorted(range(n - 1), key=lambda i: -right_common[i]):
        a, b = root(i), root(i + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        big, r = sets[a], right_common[i]
        fresh = set()
        for entry in sets[b]:
            at = bisect_left(big, entry)
            for near in (at - 1, at):
                if 0 <= near < len(big) and big[near][1] not in fresh:
                    out.append((entry[1], big[near][1], r))
            big.insert(at, entry)
            fresh.add(entry[1])
        parent[b], sets[b] = a, None
    return out


def compare(spec: Spec, c: Contexts):
    """Ranges (context, start, end relative to its anchor) that repeat in another context of its gram."""
    place = c.at[:-1] + c.left
    order = np.argsort(c.key, kind="stable")
    key = c.key[order]
    ext = Extensions(c.units, place[order], c.at[:-1][order], c.at[1:][order])
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) if len(key) else np.empty(0, np.int64)
    by_right = merge_sort(group, ext.less)
    by_left = merge_sort(group, lambda x, y: ext.less(x, y, right=False))
    rank = np.empty(len(key), np.int64)
    rank[by_left] = np.arange(len(key))
    near = ext.common(by_right[:-1], by_right[1:]) if len(key) > 1 else np.empty(0, np.int64)
    opens = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(key) else np.empty(0, np.int64)
    pairs = []
    for lo, hi in zip(opens.tolist(), [*opens[1:].tolist(), len(key)], strict=True):
        if hi - lo == 2:
            pairs.append((int(by_right[lo]), int(by_right[lo + 1]), int(near[lo])))
        elif hi - lo > 2:
            pairs += shared_pairs(by_right[lo:hi].tolist(), near[lo : hi - 1].tolist(), {int(m): int(rank[m]) for m in by_right[lo:hi]})
    if not pairs:
        none = np.empty(0, np.int64)
        return none, none, none
    x, y, right = (np.array(v, np.int64) for v in zip(*pairs, strict=True))
    left = ext.common(x, y, right=False)
    far = left + right >= spec.window
    x, y, left, right = x[far], y[far], left[far], right[far]
    raw, p = c.units, ext.place
    for i in range(len(x)):  # collision verification
        a, b = p[x[i]], p[y[i]]
        if not np.array_equal(raw[a - left[i] : a + right[i]], raw[b - left[i] : b + right[i]]):
            left[i], right[i] = ext.exact(x[i], y[i], right=False), ext.exact(x[i], y[i])
    far = left + right >= spec.window
    who = np.concatenate((order[x[far]], order[y[far]]))
    single = c.val[who] == 1
    return who[single], np.tile(-left[far], 2)[single], np.tile(right[far], 2)[single]


def dedup_suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = 4096) -> DataFrame:
    """docs with n_units (bytes), n_removed, n_spans and kept, the remaining bytes."""
    return remove_repeats(docs, Spec(window, gram, False, ELSEWHERE, compare, hot))


def op6(spark, sf_dir):
    done = dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, unnest(range(1, greatest(octet_length(b) - 398, 1))) AS i, b FROM d),
h AS (SELECT r, i, sha256(b[i:i + 399]) AS h FROM w),
g AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM h SEMI JOIN g USING (h)),
o AS (SELECT r, i, sum(CASE WHEN before IS NULL OR before + 400 < i THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM s),
spans AS (SELECT r, span, min(i) AS lo, max(i) + 400 AS hi FROM o GROUP BY r, span),
gaps AS (
  SELECT r, lag(hi, 1, 1) OVER (PARTITION BY r ORDER BY lo) AS lo, lo AS hi FROM spans
  UNION ALL SELECT d.r, coalesce(max(hi), 1), octet_length(any_value(b)) + 1 FROM d LEFT JOIN spans ON d.r = spans.r GROUP BY d.r),
kept AS (SELECT gaps.r, string_agg(substr(hex(b), (2 * lo - 1)::INT, (2 * (hi - lo))::INT), '' ORDER BY lo) AS x, sum(hi - lo) AS n FROM gaps JOIN d ON gaps.r = d.r GROUP BY gaps.r),
n AS (SELECT r, count(*) AS n FROM spans GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, (octet_length(b) - kept.n)::BIGINT AS n_removed, coalesce(n.n, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept ON d.r = kept.r LEFT JOIN n ON d.r = n.r
"""
