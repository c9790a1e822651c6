"""Page layout: orientation vote, line and block clustering, reading order.

Input rows are observations (page_id, obs_id, text, x, y, width, height, confidence); obs_id is the
input position and breaks every tie. A page is one group: its boxes are collected by one exchange and
worked on by the kernels of pagewise, batch by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import WIDE
from . import pagewise

OBSERVATION = "page_id long, obs_id int, text string, x double, y double, width double, height double, confidence double"


@dataclass(frozen=True)
class LayoutOptions:
    """line_gap_factor None means unlimited; orientation None means by vote."""

    orientation: str | None = None
    line_overlap: float = 0.4
    line_gap_factor: float | None = 1.5
    block_overlap: float = 0.3
    block_gap_factor: float = 1.2
    min_confidence: float = 0.0
    early_exit: bool = True


DEFAULT = LayoutOptions()
RECEIPT = LayoutOptions(orientation="horizontal", line_gap_factor=None, block_gap_factor=2.0)


def _voted():
    """Aggregate: vertical only where tall boxes cover more area than wide ones."""
    w, h = F.col("width"), F.col("height")
    area = lambda cond: F.sum(F.when((w > 0) & (h > 0) & cond, w * h).otherwise(0.0))
    wide, tall = area(w / F.nullif(h, F.lit(0.0)) >= WIDE), area(h / F.nullif(w, F.lit(0.0)) >= WIDE)
    return F.when(tall > wide, "vertical").otherwise("horizontal")


def vote_orientation(observations: DataFrame) -> DataFrame:
    """page_id, orientation."""
    return observations.groupBy("page_id").agg(_voted().alias("orientation"))


def with_orientation(observations: DataFrame, options: LayoutOptions) -> DataFrame:
    if options.orientation:
        return observations.withColumn("orientation", F.lit(options.orientation))
    return observations.join(vote_orientation(observations), "page_id")


BOXES = ["obs_id", "text", "x", "y", "width", "height", "confidence"]
LINE = "orientation string, text string, spaced_text string, x double, y double, width double, height double, confidence double, n_obs long, first_obs int"
ORIENTATIONS = np.array(["horizontal", "vertical"], object)


def _boxes(observations: DataFrame) -> DataFrame:
    """Observations with the types that the kernels take."""
    types = {"obs_id": "int", "text": "string"} | dict.fromkeys(["x", "y", "width", "height", "confidence"], "double")
    return observations.withColumns({k: F.col(k).cast(v) for k, v in types.items()})


def cluster_lines(observations: DataFrame, options: LayoutOptions = DEFAULT) -> DataFrame:
    """Lines of observations that carry an orientation: page_id, line (label), orientation, text,
    spaced_text, x, y, width, height, confidence, n_obs, first_obs.

    The sweep from a box ends at the first box beyond its reach, where the reach depends on the
    larger of the two; later boxes are not compared (early_exit=False compares them).
    """

    def kernel(page, vertical, f):
        page, vertical, found = pagewise.lines(page, vertical, f, options)
        return page, {"line": found.pop("line"), "orientation": ORIENTATIONS[vertical.astype(int)], **found}

    return pagewise.map_pages(_boxes(observations), BOXES, kernel, "line long, " + LINE)


def cluster_blocks(lines: DataFrame, options: LayoutOptions = DEFAULT) -> DataFrame:
    """lines with block (label) and in_block, their place in it: downwards, or leftwards if vertical.

    Lines of a block align along the reading direction and stack across it, no further apart than a
    factor of the page's median line size.
    """
    columns = [c for c in lines.columns if c not in ("page_id", "orientation")]

    def kernel(page, vertical, f):
        block, in_block = pagewise.blocks(page, vertical, f, options)
        return page, {"orientation": ORIENTATIONS[vertical.astype(int)], **f, "block": block, "in_block": in_block}

    held = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in columns)
    return pagewise.map_pages(lines, columns, kernel, f"orientation string, {held}, block long, in_block long")


def interval_bands(intervals: DataFrame, ratio: float = 0.5) -> DataFrame:
    """page_id, band, id, lo, hi of intervals (page_id, id, lo, hi): an interval joins the newest band that
    it overlaps and one of whose members it overlaps by ratio, else it opens one. Bands are numbered from
    the least lo on."""
    held = intervals.select("page_id", *[F.col(c).cast(t).alias(c) for c, t in (("id", "long"), ("lo", "double"), ("hi", "double"))])

    def kernel(page, vertical, f):
        order, band = pagewise.interval_bands(page, f["lo"], f["hi"], f["id"], ratio)
        return page[order], {"band": band.astype(np.int32), **{k: f[k][order] for k in ("id", "lo", "hi")}}

    return pagewise.map_pages(held, ["id", "lo", "hi"], kernel, "band int, id long, lo double, hi double", F.first(F.lit("horizontal")))


def xy_cut(boxes: list[tuple[float, float, float, float]], vertical: bool, min_gap: float = 0.005) -> list[int]:
    """Reading order of boxes (x, y, width, height) of one page."""
    x, y, w, h = np.array(boxes, float).reshape(-1, 4).T
    rank = pagewise.reading_ranks(np.zeros(len(x), np.int64), np.full(len(x), vertical), {"x": x, "y": y, "width": w, "height": h}, min_gap)
    return np.argsort(rank).tolist()


def reading_order(items: DataFrame) -> DataFrame:
    """page_id, item, rank of boxes (page_id, item, orientation, x, y, width, height)."""

    def kernel(page, vertical, f):
        by_item = np.lexsort((f["item"], page))
        rank = np.empty(len(page), np.int32)
        rank[by_item] = pagewise.reading_ranks(page[by_item], vertical[by_item], {k: v[by_item] for k, v in f.items()})
        return page, {"item": f["item"], "rank": rank}

    return pagewise.map_pages(items.withColumn("item", F.col("item").cast("long")), ["item", "x", "y", "width", "height"], kernel, "item long, rank int")


def _analyzed(options):
    def kernel(page, vertical, f):
        page, vertical, found = pagewise.lines(page, vertical, f, options)
        label, in_block = pagewise.blocks(page, vertical, found, options)
        members = np.lexsort((found["first_obs"], label, page))
        number = page[members] * (len(page) + 1) + label[members]
        opens = pagewise.runs(number)
        if not len(opens):
            return page, {k: found.get(k, np.empty(0)) for k in ANALYZED}
        box = pagewise.boxes_of(found, members, opens)
        head = members[opens]
        by_first = np.lexsort((found["first_obs"][head], page[head]))
        rank = np.empty(len(head), np.int64)
        rank[by_first] = pagewise.reading_ranks(page[head][by_first], vertical[head][by_first], {k: v[by_first] for k, v in box.items()})
        block_no = np.empty(len(page), np.int64)
        block_no[members] = np.repeat(rank, np.diff(np.append(opens, len(members))))
        order = np.lexsort((in_block, block_no, page))
        page = page[order]
        found = {k: v[order] if isinstance(v, np.ndarray) else v.take(order) for k, v in found.items()}
        out = {"block_no": block_no[order].astype(np.int32), "line_no": pagewise.within(page).astype(np.int32), "orientation": ORIENTATIONS[vertical[order].astype(int)], **found}
        return page, {k: out[k] for k in ANALYZED}

    return kernel


LINES = "block_no int, line_no int, orientation string, text string, spaced_text string, x double, y double, width double, height double, confidence double"
ANALYZED = [c.split()[0] for c in LINES.split(", ")]


def confident(observations: DataFrame, options: LayoutOptions = DEFAULT) -> DataFrame:
    """Observations sure enough to take part; a null confidence is not."""
    return observations.where(F.col("confidence") >= options.min_confidence)


def analyze(observations: DataFrame, options: LayoutOptions = DEFAULT) -> DataFrame:
    """Lines in reading order: page_id, block_no, line_no, orientation, text, spaced_text, x, y,
    width, height, confidence. Pages without rows are added by documents()."""
    kept = confident(_boxes(observations), options)
    turned = F.lit(options.orientation) if options.orientation else _voted()
    if options.orientation:
        turned = F.first(turned)
    return pagewise.map_pages(kept, BOXES, _analyzed(options), LINES, turned)


def lines_of_pages(boxes: pa.Table, options: LayoutOptions = DEFAULT) -> pa.Table:
    """Lines of whole pages' boxes in an Arrow table, as analyze() gives them."""
    number = {"obs_id": pa.int32()} | dict.fromkeys(["x", "y", "width", "height", "confidence"], pa.float64())
    boxes = boxes.filter(pc.greater_equal(boxes.column("confidence").cast(pa.float64()), options.min_confidence))
    ids = boxes.column("page_id").combine_chunks().dictionary_encode(null_encoding="encode")
    page = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(page, kind="stable")
    page = page[order]
    f = {c: boxes.column(c).cast(t).to_numpy()[order] for c, t in number.items()} | {"text": boxes.column("text").cast(pa.string()).combine_chunks().take(pa.array(order))}
    w, h = f["width"], f["height"]
    real = (w > 0) & (h > 0)
    tall, wide = (np.bincount(page, np.where(real & far, w * h, 0.0)) for far in (h >= WIDE * w, w >= WIDE * h))
    turned = (tall > wide)[page] if options.orientation is None else np.full(len(page), options.orientation == "vertical")
    at, found = _analyzed(options)(page, turned, f)
    found = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in found.items()}
    return pa.table({"page_id": ids.dictionary.take(pa.array(at)), **found})


def documents(lines: DataFrame, pages: DataFrame | None = None, options: LayoutOptions = DEFAULT) -> DataFrame:
    """page_id, orientation, text of analyzed lines; pages (page_id) adds those without lines."""
    text = lambda rows, sep: F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), sep)
    blocks = lines.groupBy("page_id", "block_no").agg(F.first("orientation").alias("orientation"), text(F.collect_list(F.struct("line_no", "text")), "\n").alias("text"))
    out = blocks.groupBy("page_id").agg(F.first("orientation").alias("orientation"), text(F.collect_list(F.struct("block_no", "text")), "\n\n").alias("text"))
    if pages is None:
        return out
    filled = pages.select("page_id").join(out, "page_id", "left")
    return filled.select("page_id", F.coalesce("orientation", F.lit(options.orientation or "horizontal")).alias("orientation"), F.coalesce("text", F.lit("")).alias("text"))
