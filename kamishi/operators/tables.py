"""Table reconstruction: bands of rows and columns, spanning cells, dense grids.

Bands and cells of a page are made by the kernels of pagewise: one exchange, by page.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pagewise
from .layout import BOXES, LayoutOptions, _boxes

BAND_OVERLAP = 0.5
CELLS = LayoutOptions(orientation="horizontal", line_overlap=0.5, line_gap_factor=0.6)
CELL = "row int, col int, row_span int, col_span int, text string, x double, y double, width double, height double"


def reconstruct(observations: DataFrame, ratio: float = BAND_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(cells, tables): cells (page_id, row, col, row_span, col_span, text, x, y, width, height) and
    tables (page_id, row_count, column_count). Confidence and orientation play no part."""

    def cells(page, vertical, f):
        at, found, _ = pagewise.table_cells(page, f, ratio, CELLS)
        return at, {k: v.astype(np.int32) if k in ("row", "col", "row_span", "col_span") else v for k, v in found.items()}

    def sizes(page, vertical, f):
        at, rows, cols = pagewise.table_cells(page, f, ratio, CELLS)[2]
        return at, {"row_count": rows.astype(np.int32), "column_count": cols.astype(np.int32)}

    boxes, flat = _boxes(observations), F.first(F.lit("horizontal"))
    made = lambda kernel, schema: pagewise.map_pages(boxes, BOXES, kernel, schema, flat)
    return made(cells, CELL), made(sizes, "row_count int, column_count int")


def cell_at(cells: DataFrame, row: int, col: int) -> DataFrame:
    return cells.where((F.col("row") == row) & (F.col("col") == col))


def cells_covering(cells: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (page_id, at_row, at_col) with the cell whose span holds them."""
    inside = F.col("at_row").between(F.col("row"), F.col("row") + F.col("row_span") - 1) & F.col("at_col").between(F.col("col"), F.col("col") + F.col("col_span") - 1)
    return positions.join(cells, "page_id").where(inside)


def grids(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """page_id, grid array<array<string>>: texts at their anchors, '' elsewhere."""
    held = cells.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "text"))).alias("at"))
    r, c = F.col("row_count"), F.col("column_count")
    count = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    text = lambda i, j: F.coalesce(F.try_element_at(F.col("at"), F.struct(i.alias("row"), j.alias("col"))), F.lit(""))
    grid = F.transform(count(r), lambda i: F.transform(count(c), lambda j: text(i, j)))
    return tables.join(held, "page_id", "left").select("page_id", grid.alias("grid"))
