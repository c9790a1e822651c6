"""Layouts, tables, receipts, backends and rendering on small pages."""

import json

import pytest
from pyspark.sql import functions as F

from kamishi.operators import layout, receipts, tables
from kamishi.plans import render
from kamishi.plans.engine import Engine, receipts_of
from kamishi.sources import backends
from kamishi.streaming import pages as streaming


def page(spark, boxes, page_id=1):
    rows = [(page_id, i, t, float(x), float(y), float(w), float(h), float(c[0]) if c else 1.0) for i, (t, x, y, w, h, *c) in enumerate(boxes)]
    return spark.createDataFrame(rows, layout.OBSERVATION)


COLUMNS = [("左1", 10, 40, 100, 16), ("右1", 300, 40, 100, 16), ("左2", 10, 62, 100, 16), ("右2", 300, 62, 100, 16)]
VERTICAL = [("題名", 300, 10, 20, 80), ("二列", 200, 10, 20, 300), ("一列", 240, 10, 20, 300), ("三列", 160, 10, 20, 300)]


def lines_of(df, options=layout.DEFAULT):
    return [r.text for r in layout.analyze(df, options).orderBy("line_no").collect()]


def test_reading_order(spark):
    assert lines_of(page(spark, COLUMNS)) == ["左1", "左2", "右1", "右2"]
    assert lines_of(page(spark, VERTICAL)) == ["題名", "一列", "二列", "三列"]
    noisy = page(spark, [*COLUMNS, ("x", 150, 50, 100, 16, 0.1)])
    assert lines_of(noisy, layout.LayoutOptions(min_confidence=0.5)) == ["左1", "左2", "右1", "右2"]


def test_lines(spark):
    near = page(spark, [("a", 0, 0, 20, 16), ("b", 30, 2, 20, 16), ("c", 200, 1, 20, 16)])
    assert sorted(lines_of(near)) == ["ab", "c"]
    assert lines_of(near, layout.RECEIPT) == ["abc"]
    with_zero = page(spark, [("a", 0, 0, 20, 0), ("b", 21, 0, 20, 16)])
    assert sorted(lines_of(with_zero)) == ["a", "b"]


def test_xy_cut_overlap_falls_back():
    assert layout.xy_cut([(0, 10, 50, 50), (20, 0, 50, 50)], False) == [1, 0]
    assert layout.xy_cut([(0, 0, 10, 10), (20, 0, 10, 10), (40, 0, 10, 10)], True) == [2, 1, 0]
    assert layout.xy_cut([], False) == []


TABLE = [("品名", 20, 20, 80, 20), ("数量", 140, 21, 60, 20), ("金額", 260, 19, 60, 20), ("りんご", 20, 60, 70, 20), ("3", 150, 62, 20, 20), ("¥450", 262, 61, 58, 20)]


def test_tables(spark):
    cells, sizes = tables.reconstruct(page(spark, TABLE))
    assert tables.grids(cells, sizes).first().grid == [["品名", "数量", "金額"], ["りんご", "3", "¥450"]]
    holes = page(spark, TABLE[:4] + TABLE[5:])
    grid = tables.grids(*tables.reconstruct(holes))
    assert grid.first().grid[1] == ["りんご", "", "¥450"]
    assert grid.select(render.table_markdown(F.col("grid")).alias("m")).first().m == "| 品名 | 数量 | 金額 |\n| --- | --- | --- |\n| りんご |  | ¥450 |"
    wide = page(spark, [("売上高", 140, 20, 180, 20), *[(t, x, y + 40, w, h) for t, x, y, w, h in TABLE]])
    spanning = tables.cell_at(tables.reconstruct(wide)[0], 0, 1).first()
    assert (spanning.text, spanning.col_span) == ("売上高", 2)
    assert json.loads(render.table_json(cells, sizes).first().json)["columnCount"] == 3


RECEIPT = ["スーパーマルヤマ　川崎店", "TEL 044-555-0100", "2026年7月8日 18:42", "食パン　￥138", "牛乳 x2 ¥396", "値引 -20", "小計 ¥514", "8%対象※ ¥514", "内消費税等(8%) ¥38", "合計", "¥514", "お預り ¥1,000", "お釣り ¥486", "点数 3点"]


def test_receipt(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(RECEIPT)] + [(2, 0, "")], "doc_id long, line_no int, line string")
    one, two = receipts.extract(df).orderBy("doc_id").collect()
    assert (one.storeName, one.date, one.time, one.subtotal, one.total, one.tendered, one.change, one.declaredItemCount) == ("スーパーマルヤマ 川崎店", "2026-07-08", "18:42", 514, 514, 1000, 486, 3)
    assert [(i.name, i.price, i.quantity) for i in one["items"]] == [("食パン", 138, None), ("牛乳", 396, 2), ("値引", -20, None)]
    assert [(t.rate, t.isReducedRate, t.taxableAmount, t.taxAmount) for t in one.taxLines] == [(8, True, 514, 38)]
    assert two.storeName is None and two["items"] == [] and two.taxLines == [] and two.total is None
    shown = receipts.extract(df).select("doc_id", render.receipt_markdown().alias("m"), render.receipt_json().alias("j")).orderBy("doc_id").collect()
    assert shown[0].m.startswith("# スーパーマルヤマ 川崎店\n\n2026-07-08 18:42\n\n| Item | Qty | Price |") and shown[0].m.endswith("Change: 486")
    assert json.loads(shown[0].j)["date"] == {"year": 2026, "month": 7, "day": 8}


def test_receipt_windows(spark, capsys):
    """One order of the lines serves every window, and lines are read with as few patterns as they need."""
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(RECEIPT)], "doc_id long, line_no int, line string")
    rows = receipts.classify_lines(df)
    rows.explain("simple")
    assert capsys.readouterr().out.count("+- Window ") == 1
    assert [r.line_no for r in rows.where("amount is not null").orderBy("line_no").collect()] == [6, 11, 12]  # no other line names a sum


def test_receipts_of_pages_layout_once(spark, capsys):
    """The store's name is the tallest of the first lines, the first of equals; the layout runs once for lines and names."""
    heights = {1: [16, 30, 30, 16, 16, 90], 2: [16, 16, 16, 16, 16, 90]}
    boxes = [(p, i, f"店{i}", 10.0, 100.0 * i, 200.0, float(h), 1.0) for p, hs in heights.items() for i, h in enumerate(hs)]
    out = receipts_of(spark.createDataFrame(boxes, layout.OBSERVATION))
    out.explain("simple")
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert {r.doc_id: r.storeName for r in out.collect()} == {1: "店1", 2: "店0"}


def test_engine_and_backends(spark):
    named = page(spark, [(s, 10, 30 * i, 200, 30 if i == 0 else 16) for i, s in enumerate(RECEIPT)]).withColumn("name", F.lit("receipt")).drop("page_id")
    images = spark.createDataFrame([(1, "receipt"), (2, "unknown")], "page_id long, name string")
    engine = Engine(backends.by_name(named), layout.RECEIPT)
    got = {r.doc_id: r.total for r in engine.receipt(images).collect()}
    assert got == {1: 514, 2: None}
    assert {r.page_id: r.text == "" for r in engine.document(images).collect()} == {1: False, 2: True}
    assert {r.page_id: r.row_count for r in engine.table(images)[1].collect()}[2] == 0
    assert json.loads(engine.json(images).first().json)["orientation"] == "horizontal"
    assert receipts_of(backends.constant(named)(images)).count() == 2
    with pytest.raises(Exception, match="no model"):
        backends.failing("no model")(images).collect()


def test_vocabulary(spark, tmp_path):
    good, bad, text = tmp_path / "v.json", tmp_path / "b.json", tmp_path / "v.txt"
    good.write_text('{"vocabulary": ["", "あ"], "blankIndex": 0}')
    bad.write_text('{"vocabulary": ["a"], "blankIndex": 5}')
    text.write_text("a\n\nb\n")
    assert backends.read_vocabulary(spark, str(good)).first()["count"] == 2
    with pytest.raises(Exception, match="out of range"):
        backends.read_vocabulary(spark, str(bad)).collect()
    assert backends.read_word_list(spark, str(text)).first().vocabulary == ["a", "", "b"]


def test_stream_of_pages(spark, tmp_path):
    spark.createDataFrame([(1, ["2026/7/8", "合計 ¥500"])], streaming.RECEIPT_PAGE).write.parquet(str(tmp_path / "in"))
    stream = streaming.with_facts(streaming.read_pages(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("facts").start()
    try:
        q.processAllAvailable()
        facts = spark.table("facts").first().facts
    finally:
        q.stop()
    assert (facts[0].date, facts[1].amount) == ("2026-07-08", 500)
