"""Markdown and JSON of layouts, tables and receipts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ymd
from ..functions.text import escape_cell, trim_trailing_newlines


def table_markdown(grid: Column) -> Column:
    """Pipe table, first row as header; '' for an empty grid."""
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rows = F.transform(grid, lambda r: row(F.transform(r, escape_cell)))
    rule = row(F.transform(grid[0], lambda _: F.lit("---")))
    full = F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.size(rows))), "\n")
    return F.when(F.size(grid) == 0, "").when(F.size(F.get(grid, F.lit(0))) == 0, "").otherwise(full)


def receipt_markdown() -> Column:
    """Markdown summary over the columns of a receipt."""
    text = lambda head, c, tail="": F.when(F.col(c).isNotNull(), F.concat(F.lit(head), F.col(c).cast("string"), F.lit(tail)))
    given = lambda *parts: F.filter(F.array(*parts), lambda p: p.isNotNull())
    lines = lambda cond, *parts: F.when(cond, F.array(*parts)).otherwise(F.array().cast("array<string>"))
    meta = F.concat_ws(" ", "date", "time")
    item = lambda i: F.concat(F.lit("| "), escape_cell(i["name"]), F.lit(" | "), F.coalesce(i["quantity"].cast("string"), F.lit("")), F.lit(" | "), i["price"].cast("string"), F.lit(" |"))
    has_items = F.size("items") > 0

    def tax(t):
        rate = F.when(t["rate"].isNotNull(), F.concat(t["rate"].cast("string"), F.lit("%"), F.when(t["isReducedRate"], " (reduced)").otherwise("")))
        parts = given(rate, F.concat(F.lit("taxable "), t["taxableAmount"].cast("string")), F.concat(F.lit("tax "), t["taxAmount"].cast("string")))
        return F.when(F.size(parts) > 0, F.concat(F.lit("Tax: "), F.array_join(parts, ", ")))

    body = F.concat(
        lines(F.col("storeName").isNotNull(), F.concat(F.lit("# "), F.col("storeName")), F.lit("")),
        lines(meta != "", meta, F.lit("")),
        lines(has_items, F.lit("| Item | Qty | Price |"), F.lit("| --- | --- | --- |")), F.transform("items", item), lines(has_items, F.lit("")),
        given(text("Subtotal: ", "subtotal"), text("**Total: ", "total", "**")),
        F.filter(F.transform("taxLines", tax), lambda t: t.isNotNull()),
        given(text("Tendered: ", "tendered"), text("Change: ", "change")),
    )
    return trim_trailing_newlines(F.array_join(body, "\n"))


def receipt_json(pretty: bool = True) -> Column:
    """Keys sorted, nulls left out; the date as year, month and day."""
    names = ["change", "date", "declaredItemCount", "items", "rawLines", "storeName", "subtotal", "taxLines", "tendered", "time", "total"]
    row = F.struct(*[ymd(F.col(n)).alias(n) if n == "date" else F.col(n) for n in names])
    return F.to_json(row, {"pretty": str(pretty).lower()})


def layout_json(lines: DataFrame, pretty: bool = True, pages: DataFrame | None = None, orientation: str = "horizontal") -> DataFrame:
    """page_id, json of analyzed lines: blocks of lines in reading order, keys sorted. pages (page_id) adds
    those without lines: no blocks, in the orientation given."""
    box = F.struct("height", "width", "x", "y").alias("boundingBox")
    blocks = lines.groupBy("page_id", "block_no").agg(F.first("orientation").alias("orientation"), F.array_sort(F.collect_list(F.struct("line_no", box, "confidence", "text"))).alias("ls"))
    rows = F.transform("ls", lambda x: F.struct(x["boundingBox"].alias("boundingBox"), x["confidence"].alias("confidence"), x["text"].alias("text")))
    found = blocks.groupBy("page_id").agg(F.first("orientation").alias("orientation"), F.array_sort(F.collect_list(F.struct("block_no", rows.alias("lines"), "orientation"))).alias("bs"))
    found = found if pages is None else pages.select("page_id").join(found, "page_id", "left")
    listed = F.transform("bs", lambda b: F.struct(b["lines"].alias("lines"), b["orientation"].alias("orientation")))
    doc = F.struct(F.coalesce(listed, F.array()).alias("blocks"), F.coalesce("orientation", F.lit(orientation)).alias("orientation"))
    return found.select("page_id", F.to_json(doc, {"pretty": str(pretty).lower()}).alias("json"))


def table_json(cells: DataFrame, tables: DataFrame, pretty: bool = True) -> DataFrame:
    box = F.struct("height", "width", "x", "y").alias("boundingBox")
    row = F.struct("row", "col", box, "col_span", "row_span", "text")
    held = cells.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("cs"))
    out = F.transform("cs", lambda c: F.struct(c["boundingBox"].alias("boundingBox"), c["col"].alias("column"), c["col_span"].alias("columnSpan"), c["row"].alias("row"), c["row_span"].alias("rowSpan"), c["text"].alias("text")))
    joined = tables.join(held, "page_id", "left")
    doc = F.struct(F.coalesce(out, F.array()).alias("cells"), F.col("column_count").alias("columnCount"), F.col("row_count").alias("rowCount"))
    return joined.select("page_id", F.to_json(doc, {"pretty": str(pretty).lower()}).alias("json"))
