"""Best-fit packing into bins of several permitted lengths.

A document longer than the largest capacity is cut into pieces of that capacity; only its last piece
is packed with others. Pieces are dealt into shards by a hash and packed there in falling length: each
goes into the open bin that it fills best; if none has room, a bin is opened. All permitted sizes
compete for it: each is filled, on trial, from the lengths still to be placed, and the one whose cost
per token held is least is opened. At the end every bin is downsized to the smallest permitted length
that holds its contents. A sequence costs its length, a fixed overhead, and attention, which grows with
the square; so a larger bin wastes less room and a smaller one less attention. Shards are sized by
pieces, so they grow in number, not in size.

Documents of null or no length take no bin and give no row. Texts may be of any length: a whole piece
is a row of its own. Equal lengths go by id, null last. Rows with equal ids are separate documents. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, words_of

CAPACITIES = (512, 1024, 2048, 4096)
#: What a sequence costs besides its length, in tokens; and the length at which attention costs as much as the rest.
OVERHEAD, ATTENTION = 32, 16384
SHARD_ROWS = 20_000
LAST = 2**63 - 1
SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("length", pa.int64()), ("shard", pa.int64()), ("bin", pa.int64()), ("capacity", pa.int64()), ("position", pa.int32()), ("start", pa.int64())])
DDL = "doc_id long, piece int, length long, shard long, bin long, capacity long, position int, start long"


def bin_cost(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return capacity + overhead + capacity * capacity / attention


def downsized(used: int, capacities=CAPACITIES) -> int:
    return min(c for c in capacities if c >= used)


class Lengths:
    """How many pieces of each length are still to be placed."""

    def __init__(self, lengths):
        self.left = Counter(lengths)
        self.lower = list(range(max(lengths, default=0) + 1))  # towards the next lower length that is left

    def most(self, room: int) -> int:
        """The greatest length left of at most room, 0 if there is none."""
        at = min(room, len(self.lower) - 1)
        path = []
        while at > 0 and not self.left[at]:
            path.append(at)
            at = self.lower[at] if self.lower[at] < at else at - 1
        for x in path:
            self.lower[x] = at
        return at

    def fill(self, room: int) -> int:
        """Tokens that a room takes if the longest piece that fits always goes in; nothing is placed."""
        held, top = 0, room
        while (n := self.most(min(top, room - held))) > 0:
            held += n * min(self.left[n], (room - held) // n)
            top = n - 1
        return held


def best_fit(lengths, capacities=CAPACITIES, cost=bin_cost) -> list[tuple[int, int]]:
    """(bin, start) of each length; lengths must fall and none exceeds the largest capacity.

    Of the sizes for a new bin the one with the least cost per token on its trial is opened; ties go
    to the smaller one.
    """
    ahead = Lengths(lengths)
    room: list[tuple[int, int]] = []  # (free, bin), rising
    used: list[int] = []
    out = []

    def price(c, n):
        held = n + ahead.fill(c - n)
        return cost(downsized(held, capacities)) / held

    for n in lengths:
        ahead.left[n] -= 1
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(used)
            free = min((c for c in capacities if c >= n), key=lambda c: (price(c, n), c))
            used.append(0)
        out.append((b, used[b]))
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return out


def _pack(capacities, cost):
    def run(rows: pa.Table) -> pa.Table:
        ids, piece, length = (rows.column(c).to_numpy() for c in ("id", "piece", "length"))
        order = np.lexsort((piece, ids, -length))
        ids, piece, length = ids[order], piece[order], length[order]
        placed = np.array(best_fit(length.tolist(), capacities, cost), np.int64).reshape(-1, 2)
        held = np.bincount(placed[:, 0], length).astype(np.int64)
        capacity = np.array(capacities)[np.searchsorted(capacities, held)][placed[:, 0]]
        by_bin = np.lexsort((placed[:, 1], placed[:, 0]))
        opens = np.flatnonzero(np.append(True, np.diff(placed[by_bin, 0]) > 0))
        position = np.empty(len(order), np.int32)
        position[by_bin] = np.arange(len(order)) - np.repeat(opens, np.diff(np.append(opens, len(order))))
        shard = rows.column("shard").to_numpy()
        cols = [pa.array(ids, mask=ids == LAST), piece, length, shard, placed[:, 0], capacity, position, placed[:, 1]]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=SCHEMA)

    return run


def pack(docs: DataFrame, length: Column | None = None, capacities=CAPACITIES, cost=bin_cost) -> DataFrame:
    """Pieces with their bin (shard, bin), its final capacity, their place and first token in it.

    length: tokens of a document; words of its text unless given. cost: of a sequence of a capacity.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    size = F.size(words_of(F.col("text"))) if length is None else length
    sized = materialize(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), size.cast("long").alias("n")).where("n > 0"), "lengths")
    last = ((F.col("n") - 1) / top).cast("int")
    shards = max(1, (sized.agg(F.sum(last + 1)).first()[0] or 0) // SHARD_ROWS)
    pieces = sized.select("id", F.explode(F.sequence(F.lit(0), last)).alias("piece"), "n")
    pieces = pieces.select("id", "piece", F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("long").alias("length"))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "length"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack(capacities, cost), DDL)


def op8(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
