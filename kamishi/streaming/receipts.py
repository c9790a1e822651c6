"""Receipts that arrive line by line, in any order and over many micro-batches.

Lines of a doc_id belong together while no more than `gap` lies between their times: a session window
gathers them in the state store, joins sessions that a line in between connects, and closes one when
the watermark, `delay` behind the latest time, has passed its last line by `gap`. A closed receipt is
emitted once, whole, and its state goes, so state holds only receipts still open. A late line, whose own
session of `gap` lies behind the watermark, is dropped: it never changes a receipt that was emitted.
Lines without a time or a doc_id are no part of a receipt. Repeated lines and equal line numbers are
kept as in a batch. Lines of a doc_id further apart than `gap` are several receipts, told apart by
`opened`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import receipts
from .pages import per_batch

DELAY, GAP = "10 minutes", "5 minutes"


def whole_receipts(lines: DataFrame, delay: str = DELAY, gap: str = GAP) -> DataFrame:
    """doc_id, opened, line_no, line: the lines of closed receipts of a stream (doc_id, time, line_no, line)."""
    kept = lines.select("doc_id", "time", "line_no", "line").where("time is not null and doc_id is not null")
    session = kept.withWatermark("time", delay).groupBy(F.session_window("time", gap).alias("session"), "doc_id")
    held = session.agg(F.collect_list(F.struct("line_no", "line")).alias("rows"))
    return held.select("doc_id", F.col("session.start").alias("opened"), F.inline("rows"))


def extract_closed(closed: DataFrame) -> DataFrame:
    """doc_id, opened and the fields of each receipt in a batch of whole_receipts()."""
    done = receipts.extract(closed.select(F.struct("doc_id", "opened").alias("doc_id"), "line_no", "line"))
    return done.select("doc_id.*", *[c for c in done.columns if c != "doc_id"])


def receipt_stream(lines: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, delay: str = DELAY, gap: str = GAP):
    """Start a query that hands the receipts closed by each micro-batch to write()."""
    return per_batch(whole_receipts(lines, delay, gap), extract_closed, write, checkpoint)
