"""Scalar functions on the expected results of the blueprint's fixtures."""

import pytest
from pyspark.sql import functions as F

from kamishi.functions import ctc, dates, geometry, numbers, text


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r.v for r in df.select("i", f(F.col("s")).alias("v")).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, text.normalize, ["ＡＢＣ１２３　！", "ｶﾞｷﾞﾊﾟ", "ﾞ", None]) == ["ABC123 !", "ガギパ", "゛", None]
    assert values(spark, text.normalize_all, ["  ａ \t　ｂ \n c  "]) == ["a b\nc"]
    assert values(spark, text.escape_cell, ["a|b\nc"]) == ["a\\|b<br>c"]
    assert values(spark, text.trim_name, ["* コーヒー・・…", "＊パン:"]) == ["コーヒー", "パン"]
    assert values(spark, text.strip_rates, ["8%対象 10 % x"]) == ["対象  x"]


def test_numbers(spark):
    kanji = ["二〇二六", "十", "千二百三十四", "三万五千", "一億二千万", "〇", "百千", "", "円", "12", "99999999999999999999"]
    assert values(spark, numbers.kanji_number, kanji) == [2026, 10, 1234, 35000, 120_000_000, 0, 1100, None, None, 12, None]
    assert values(spark, numbers.parse_amount, ["¥1,234", "1,234円 5", "5 678", "▲300円", "なし", "−50"]) == [1234, 1234, 678, -300, None, -50]
    assert values(spark, numbers.standalone_amount, ["¥ 500", " 1,000円 ", "計 500", "-20"]) == [500, 1000, None, -20]
    found = values(spark, numbers.amounts, ["¥100 と 200円 3"])[0]
    assert [(m.amount, m.marked) for m in found] == [(100, True), (200, True), (3, False)]


@pytest.mark.parametrize(
    ("s", "want"),
    [
        ("2026年7月8日", "2026-07-08"), ("2026/07/08", "2026-07-08"), ("令和8年7月8日", "2026-07-08"), ("令和元年5月1日", "2019-05-01"), ("R8.7.8", "2026-07-08"),
        ("H30/1/5", "2018-01-05"), ("26/07/08", "2026-07-08"), ("２０２６．７．８", "2026-07-08"), ("2026-02-30", None), ("2024-02-29", "2024-02-29"),
        ("1900/2/29", None), ("x", None), ("ATM3.1.2", "1870-01-02"), ("0120-11-11", "0120-11-11"), ("1126/07/08x", "1126-07-08"),
    ],
)
def test_dates(spark, s, want):
    assert values(spark, dates.parse_date, [s]) == [want]


def test_times(spark):
    assert values(spark, dates.parse_time, ["18:42", "9:05分", "24:00", "１２：３４", "x"]) == ["18:42", "09:05", None, "12:34", None]


def test_geometry(spark):
    df = spark.createDataFrame([(10.0, 5.0), (5.0, 10.0), (5.0, 5.0), (0.0, 9.0), (16.0, 10.0)], "w double, h double")
    assert [r[0] for r in df.select(geometry.classify_region(F.col("w"), F.col("h"))).collect()] == ["horizontal", "vertical", None, None, "horizontal"]
    rows = spark.createDataFrame([(1, 0.0, 10.0, 0), (1, 2.0, 5.0, 1), (1, 12.0, 20.0, 2), (1, 19.0, 30.0, 3), (1, 40.0, 41.0, 4)], "p int, lo double, hi double, id long")
    assert sorted((r.lo, r.hi) for r in geometry.interval_gaps(rows, ["p"]).collect()) == [(10.0, 12.0), (30.0, 40.0)]
    bands = rows.groupBy("p").agg(geometry.bands(F.collect_list(F.struct("lo", "hi", "id")), 0.5).alias("b")).first().b
    assert [[m.id for m in b.members] for b in bands] == [[0, 1], [2], [3], [4]]


def test_ctc(spark):
    vocabulary = F.array(*[F.lit(c) for c in ["", "あ", "い", "う"]])
    df = spark.createDataFrame([([1, 1, 0, 2, 2, 3],), ([1, 0, 1, 9, 9, 1],), ([],)], "a array<int>")
    assert [r.d.text for r in df.select(ctc.decode_indices(F.col("a"), vocabulary).alias("d")).collect()] == ["あいう", "あああ", ""]
    m = [[0.1, 0.9, 0.0, 0.0], [0.8, 0.1, 0.1, 0.0], [], [0.0, 0.3, 0.6, 0.1], [0.0, 0.2, 0.7, 0.1]]
    d = spark.createDataFrame([(m,), ([],)], "m array<array<double>>").select(ctc.decode_logits(F.col("m"), vocabulary).alias("d")).collect()
    assert d[0].d.text == "あい" and abs(d[0].d.confidence - 0.75) < 1e-9 and d[1].d.confidence == 0.0
    up = spark.createDataFrame([([[0.0], [1.0]],)], "m array<array<double>>").select(ctc.align_timesteps(F.col("m"), 4).alias("v")).first().v
    assert [round(x[0], 6) for x in up] == [0.0, 0.25, 0.75, 1.0]
