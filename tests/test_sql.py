"""Functions in SQL give what the Column functions give; the table function with options and any page name."""

import random

import pytest
from pyspark.sql import functions as F

from kamishi.functions import numbers
from kamishi.operators import layout
from kamishi.plans import sql

TEXTS = [
    None, "", "¥1,234", "計 ￥5 と 6円", "▲300円", "-20", " 1,000円 ", "なし", "令和8年7月8日 18:42", "2026/7/8", "26.07.08", "９：０５", "24:00", "平成15/13/1 2003.4.5", "三万五千", "一億二千万", "百千", "〇", "円", "ｶﾞｷﾞﾊﾟ ﾞ",
    "99999999999999999999", "＊ コーヒー ・・", "a|b\nc", "8%対象 10 %", "十〇万", "万億", "〇千", "2020-02-29", "H30/1/5 と R1.5.1", "  ａ \t　ｂ \n c  ",
]


@pytest.mark.parametrize("name", [n for n, (a, _) in sql.SCALARS.items() if a == "s STRING"])
def test_functions_of_a_string(spark, name):
    sql.register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, s string")
    want = df.select("i", sql.SCALARS[name][1](F.col("s")).alias("v")).orderBy("i").collect()
    assert spark.sql(f"SELECT i, {name}(s) AS v FROM {{df}} ORDER BY i", df=df).collect() == want


def test_bodies_are_inlined(spark):
    sql.register(spark)
    df = spark.createDataFrame([("三",)], "s string")
    plan = spark.sql("SELECT kanji_number(s) AS a, parse_amount(s) AS b, parse_date(s) AS c FROM {df}", df=df)._jdf.queryExecution().optimizedPlan().toString()
    assert "kanji_number(" not in plan and "parse_date(" not in plan and "Python" not in plan


def kanji(s):
    """The value by a walk over the characters."""
    digits, units = dict(zip("〇一二三四五六七八九零0123456789", [*range(10), 0, *range(10)], strict=True)), {"十": 10, "百": 100, "千": 1000, "万": 10**4, "億": 10**8, "兆": 10**12}
    if not s or any(c not in digits and c not in units for c in s):
        return None
    total = section = current = 0
    for c in s:
        if c in digits:
            current = current * 10 + digits[c]
        elif units[c] < 10**4:
            section, current = section + (current or 1) * units[c], 0
        else:
            total, section, current = total + ((section + current) or 1) * units[c], 0, 0
    value = total + section + current
    return value if value < 1 << 63 else None


def test_kanji_numbers(spark):
    r = random.Random(3)
    some = ["".join(r.choice("〇一二三九十百千万億兆05" + "x" * (k % 9 == 0)) for _ in range(r.randint(1, 7))) for k in range(4000)]
    some += ["".join(x for u in "千百十" for x in [r.choice(["", "二" + u, u, "〇" + u, "１２".translate({65297: "1", 65298: "2"}) + u])] ) + r.choice(["", "七", "〇"]) for _ in range(300)]
    some += [a + "兆" + b + "億" + c + "万" + d for a, b, c, d in (r.sample(some[-300:], 4) for _ in range(300))]
    some += ["九" * n for n in range(15, 24)] + ["九千兆", "九百万兆", "0" * 30 + "5", "9223372036854775807", "9223372036854775808", "二十二百", "十0万", "千\n", "1,000", "一,二", ",,,", "1,,,,,,,,,,,,,,,2"]
    df = spark.createDataFrame([(s,) for s in some], "s string")
    got = {x.s: x.v for x in df.select("s", numbers.kanji_number(F.col("s")).alias("v")).collect()}
    assert {s: got[s] for s in some} == {s: kanji(s) for s in some}


PAGES = [("p1", 0, "左", 10.0, 10.0, 40.0, 16.0, 1.0), ("p1", 1, "右", 300.0, 11.0, 40.0, 16.0, 1.0), ("p1", 2, "薄", 60.0, 10.0, 40.0, 16.0, 0.2), ("p2", 0, "下", 10.0, 90.0, 40.0, 16.0, 1.0)]


def test_page_lines(spark):
    sql.register(spark)
    df = spark.createDataFrame(PAGES, layout.OBSERVATION.replace("page_id long", "page_id string")).withColumn("extra", F.lit(1))
    read = lambda options="": sorted((x.page_id, x.line_no, x.text) for x in spark.sql(f"SELECT * FROM page_lines_by_name(TABLE(SELECT * FROM {{df}}) PARTITION BY (page_id){options})", df=df).collect())
    assert read() == [("p1", 0, "左薄"), ("p1", 1, "右"), ("p2", 0, "下")]
    assert read(""", '{{"min_confidence": 0.5}}'""") == [("p1", 0, "左"), ("p1", 1, "右"), ("p2", 0, "下")]
    assert read(""", '{{"min_confidence": 0.5, "line_gap_factor": null}}'""") == [("p1", 0, "左右"), ("p2", 0, "下")]
    assert read(""", '{{"min_confidence": 2}}'""") == []
    numbered = df.withColumn("page_id", F.when(F.col("page_id") == "p1", 1).otherwise(2).cast("long"))
    for partition in ("PARTITION BY page_id", "WITH SINGLE PARTITION"):
        got = spark.sql(f"SELECT * FROM page_lines(TABLE(SELECT * FROM {{df}}) {partition}) ORDER BY page_id, line_no", df=numbered).collect()
        assert got == layout.analyze(numbered).orderBy("page_id", "line_no").collect()
    with pytest.raises(Exception, match="unknown layout options"):
        read(""", '{{"gap": 1}}'""")
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM page_lines(TABLE(SELECT page_id FROM {df}) PARTITION BY page_id)", df=numbered).collect()
