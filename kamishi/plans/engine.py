"""The pipeline over a backend: observations, documents, receipts, tables, markdown, JSON per page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_all
from ..operators import layout, receipts, tables
from . import render


def receipts_of(observations: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Receipts (doc_id = page_id) of observations: receipt layout, and the tallest of the first lines
    as the store's name if it may be one."""
    lines = layout.analyze(observations, layout.RECEIPT).select(F.col("page_id").alias("doc_id"), "line_no", F.col("spaced_text").alias("line"), "height")
    # in the order that the receipts want, so the layout is made once and its lines are exchanged once
    page = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tallest = F.max(F.when(F.col("line_no") < receipts.HINT_LINES, F.struct("height", -F.col("line_no"))))
    out = receipts.extract(lines.withColumn("hint", -tallest.over(page)["col2"]), "hint")
    if pages is None:
        return out
    filled = pages.select(F.col("page_id").alias("doc_id")).join(out, "doc_id", "left")
    empty = {c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)) for c in ("items", "rawLines", "taxLines")}
    return filled.withColumns(empty)


@dataclass(frozen=True)
class Engine:
    """backend: images (page_id, ...) to observations; the other parts can be swapped."""

    backend: Callable[[DataFrame], DataFrame]
    options: layout.LayoutOptions = layout.DEFAULT
    band_overlap: float = tables.BAND_OVERLAP

    def observations(self, images: DataFrame) -> DataFrame:
        return self.backend(images)

    def lines(self, images: DataFrame) -> DataFrame:
        return layout.analyze(self.backend(images), self.options)

    def document(self, images: DataFrame) -> DataFrame:
        return layout.documents(self.lines(images), images, self.options)

    def receipt(self, images: DataFrame) -> DataFrame:
        return receipts_of(self.backend(images), images)

    def table(self, images: DataFrame) -> tuple[DataFrame, DataFrame]:
        cells, found = tables.reconstruct(self.backend(images), self.band_overlap)
        sizes = images.select("page_id").join(found, "page_id", "left").na.fill(0, ["row_count", "column_count"])
        return cells, sizes

    def markdown(self, images: DataFrame) -> DataFrame:
        return self.document(images).select("page_id", F.col("text").alias("markdown"))

    def json(self, images: DataFrame, pretty: bool = True) -> DataFrame:
        return render.layout_json(self.lines(images), pretty, images, self.options.orientation or "horizontal")


__all__ = ["Engine", "normalize_all", "receipts_of"]
