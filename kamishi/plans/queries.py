"""Registered queries: operators applied to inputs synthesized from the star-schema tables.

Receipts, pages and tables are built by SQL over whole tables; every oracle states the expected
result in closed form from the same base tables, not by repeating the operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import ctc, dates, geometry, numbers, text
from ..operators import bigpages, boxes, layout, receipts, tables
from ..sources import backends, pagefiles, shared
from . import render, sql
from .engine import Engine

QUERIES: dict = {}
ORACLES: dict = {}
TABLES = ("orders", "lineitem", "part", "events", "embeddings", "documents", "pages")


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def run_sql(spark, sf_dir, statement):
    """SQL over the tables named in braces."""
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in statement}
    return spark.sql(statement, **named)


# --- receipts ---------------------------------------------------------------------------------

#: Items of an order: number, name, price; the same text runs in both engines.
ITEMS = """
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS n,
       l_partkey AS part, CAST(l_quantity AS BIGINT) * 100 + l_linenumber AS price, CAST(l_quantity AS BIGINT) AS qty
FROM {lineitem}"""
SUMS = f"SELECT doc_id, CAST(sum(price) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n_items FROM ({ITEMS}) GROUP BY doc_id"
#: Kanji date in the Heisei era (1995 to 2001) and a time of day for each order.
LINES = f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part_no, n) - 1 AS INT) AS line_no, line FROM (
  SELECT doc_id, 3 AS part_no, n, concat('ｼｮｳﾋﾝ', CAST(part AS STRING), '番 ｘ', CAST(qty AS STRING), '　￥', CAST(price AS STRING)) AS line FROM ({ITEMS})
  UNION ALL SELECT doc_id, CASE WHEN pos < 3 THEN pos ELSE pos + 1 END, CAST(0 AS BIGINT), line FROM (SELECT o_orderkey AS doc_id, posexplode(array(
      concat('スーパー　ｶﾜｻｷ', CAST(o_custkey AS STRING), '号店'),
      concat('平成', CAST(year(o_orderdate) - 1988 AS STRING), '年', CAST(month(o_orderdate) AS STRING), '月', CAST(day(o_orderdate) AS STRING), '日 ', CAST(o_orderkey % 24 AS STRING), ':', lpad(CAST(o_custkey % 60 AS STRING), 2, '0')),
      'TEL 044-555-0100',
      concat('小計 ¥', CAST(total AS STRING)),
      concat('8%対象※ ¥', CAST(total AS STRING), ' (内税 ¥', CAST(n_items AS STRING), ')'),
      concat('内消費税等(8%) ¥', CAST(n_items + 1 AS STRING)),
      concat('消費税(10%) ¥', CAST(n_items + 2 AS STRING)),
      CASE WHEN total IS NULL THEN NULL WHEN o_orderkey % 2 = 0 THEN concat('合計 ', CAST(total AS STRING), '円') ELSE '合　計 合計' END,
      CASE WHEN o_orderkey % 2 = 1 THEN concat('¥', CAST(total AS STRING)) END,
      concat('お預り合計 ¥', CAST(total + 1000 AS STRING)),
      CASE WHEN total IS NOT NULL THEN 'お釣り ¥1,000' END,
      concat('お買上点数 ', CAST(n_items AS STRING), '点'))) AS (pos, line)
    FROM {{orders}} LEFT JOIN ({SUMS}) AS s ON o_orderkey = s.doc_id) WHERE line IS NOT NULL)"""


def bare(statement: str) -> str:
    """The statement for DuckDB: no braces around tables."""
    return statement.replace("{{", "{").replace("}}", "}").replace("{", "").replace("}", "").replace("AS STRING)", "AS VARCHAR)")


def receipt_lines(spark, sf_dir):
    return run_sql(spark, sf_dir, LINES.replace("{{", "{").replace("}}", "}"))


@query(f"""
WITH s AS ({bare(SUMS)})
SELECT o_orderkey AS doc_id, 'スーパー カワサキ' || o_custkey || '号店' AS store, strftime(o_orderdate, '%Y-%m-%d') AS date,
       lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_custkey % 60)::VARCHAR, 2, '0') AS time,
       s.total AS subtotal, s.total, s.total + 1000 AS tendered, CASE WHEN s.total IS NOT NULL THEN 1000::BIGINT END AS change,
       s.n_items AS declared, coalesce(s.n_items, 0) AS n_items, coalesce(s.total, 0) AS items_total,
       (3 + coalesce(s.n_items, 0) + CASE WHEN s.total IS NULL THEN 0 ELSE 8 + o_orderkey % 2 END)::BIGINT AS n_lines
FROM orders LEFT JOIN s ON o_orderkey = s.doc_id""")
def receipt_fields(spark, sf_dir):
    r = receipts.extract(receipt_lines(spark, sf_dir))
    return r.select(
        "doc_id", F.col("storeName").alias("store"), "date", "time", "subtotal", "total", "tendered", "change", F.col("declaredItemCount").alias("declared"),
        F.size("items").cast("long").alias("n_items"), receipts.items_total(F.col("items")).alias("items_total"), F.size("rawLines").cast("long").alias("n_lines"),
    )


@query(f"SELECT doc_id, n AS item_no, 'ショウヒン' || part || '番' AS name, price, qty AS quantity FROM ({bare(ITEMS)})")
def receipt_items(spark, sf_dir):
    r = receipts.extract(receipt_lines(spark, sf_dir)).select("doc_id", F.posexplode("items").alias("i", "item"))
    return r.select("doc_id", (F.col("i") + 1).cast("long").alias("item_no"), "item.name", "item.price", "item.quantity")


@query(f"""
SELECT doc_id, 8::BIGINT AS rate, true AS reduced, total AS taxable, n_items AS tax FROM ({bare(SUMS)})
UNION ALL SELECT doc_id, 10, false, NULL, n_items + 2 FROM ({bare(SUMS)})""")
def receipt_tax(spark, sf_dir):
    r = receipts.extract(receipt_lines(spark, sf_dir)).select("doc_id", F.explode("taxLines").alias("t"))
    return r.select("doc_id", "t.rate", F.col("t.isReducedRate").alias("reduced"), F.col("t.taxableAmount").alias("taxable"), F.col("t.taxAmount").alias("tax"))


@query(f"SELECT doc_id, total FROM ({bare(SUMS)}) WHERE doc_id % 2 = 1")
def receipt_pending(spark, sf_dir):
    rows = receipts.classify_lines(receipt_lines(spark, sf_dir))
    return rows.where(F.col("taken")).select("doc_id", F.col("value").alias("total"))


@query(f"""
WITH i AS (SELECT doc_id, string_agg('| ショウヒン' || part || '番 | ' || qty || ' | ' || price || ' |', chr(10) ORDER BY n) AS rows FROM ({bare(ITEMS)}) GROUP BY doc_id),
s AS ({bare(SUMS)})
SELECT o_orderkey AS doc_id, '# スーパー カワサキ' || o_custkey || '号店' || chr(10) || chr(10) || strftime(o_orderdate, '%Y-%m-%d') || ' ' ||
       lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_custkey % 60)::VARCHAR, 2, '0') ||
       coalesce(chr(10) || chr(10) || '| Item | Qty | Price |' || chr(10) || '| --- | --- | --- |' || chr(10) || rows || chr(10) || chr(10) || 'Subtotal: ' || total || chr(10) || '**Total: ' || total || '**' || chr(10) ||
       'Tax: 8% (reduced), taxable ' || total || ', tax ' || n_items || chr(10) || 'Tax: 10%, tax ' || (n_items + 2) || chr(10) || 'Tendered: ' || (total + 1000) || chr(10) || 'Change: 1000', '') AS markdown
FROM orders LEFT JOIN s ON o_orderkey = s.doc_id LEFT JOIN i ON o_orderkey = i.doc_id""")
def receipt_markdown(spark, sf_dir):
    return receipts.extract(receipt_lines(spark, sf_dir)).select("doc_id", render.receipt_markdown().alias("markdown"))


@query(f"""
WITH s AS ({bare(SUMS)}),
i AS (
  SELECT doc_id, string_agg('{{{{"name":"ショウヒン' || part || '番","price":' || price || ',"quantity":' || qty || '}}}}', ',' ORDER BY n) AS items,
         string_agg('"ショウヒン' || part || '番 x' || qty || ' ￥' || price || '"', ',' ORDER BY n) AS lines FROM ({bare(ITEMS)}) GROUP BY doc_id),
o AS (
  SELECT o_orderkey AS doc_id, o_custkey AS cust, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 24 AS h, lpad((o_custkey % 60)::VARCHAR, 2, '0') AS mi, total, n_items AS n, items, lines
  FROM orders LEFT JOIN s ON o_orderkey = s.doc_id LEFT JOIN i ON o_orderkey = i.doc_id)
SELECT doc_id, '{{{{' || CASE WHEN total IS NULL THEN '' ELSE '"change":1000,' END || '"date":{{{{"day":' || d || ',"month":' || m || ',"year":' || y || '}}}},' || coalesce('"declaredItemCount":' || n || ',', '') ||
       '"items":[' || coalesce(items, '') || '],"rawLines":["スーパー カワサキ' || cust || '号店","平成' || (y - 1988) || '年' || m || '月' || d || '日 ' || h || ':' || mi || '","TEL 044-555-0100"' ||
       coalesce(',' || lines || ',"小計 ¥' || total || '","8%対象※ ¥' || total || ' (内税 ¥' || n || ')","内消費税等(8%) ¥' || (n + 1) || '","消費税(10%) ¥' || (n + 2) || '",' ||
         CASE WHEN doc_id % 2 = 0 THEN '"合計 ' || total || '円"' ELSE '"合 計 合計","¥' || total || '"' END || ',"お預り合計 ¥' || (total + 1000) || '","お釣り ¥1,000","お買上点数 ' || n || '点"', '') ||
       '],"storeName":"スーパー カワサキ' || cust || '号店",' || coalesce('"subtotal":' || total || ',', '') || '"taxLines":[' ||
       coalesce('{{{{"isReducedRate":true,"rate":8,"taxAmount":' || n || ',"taxableAmount":' || total || '}}}},{{{{"isReducedRate":false,"rate":10,"taxAmount":' || (n + 2) || '}}}}', '') || '],' ||
       coalesce('"tendered":' || (total + 1000) || ',', '') || '"time":"' || lpad(h::VARCHAR, 2, '0') || ':' || mi || '"' || coalesce(',"total":' || total, '') || '}}}}' AS json
FROM o""".replace("{{", "{").replace("}}", "}"))
def receipt_json(spark, sf_dir):
    return receipts.extract(receipt_lines(spark, sf_dir)).select("doc_id", render.receipt_json(pretty=False).alias("json"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE p_name || ' 本店' END AS store FROM part""")
def store_name(spark, sf_dir):
    lines = run_sql(spark, sf_dir, """
      SELECT p_partkey AS doc_id, 0 AS line_no, CASE p_partkey % 4 WHEN 0 THEN concat(p_name, ' 本店') WHEN 1 THEN 'TEL 03-1234-5678' ELSE '領収証' END AS line FROM {part}
      UNION ALL SELECT p_partkey, 1, '2026-07-08 18:42' FROM {part}
      UNION ALL SELECT p_partkey, 2, CASE p_partkey % 4 WHEN 1 THEN concat(p_name, ' 本店') WHEN 2 THEN '合計 ¥100' ELSE '¥100' END FROM {part}
      UNION ALL SELECT p_partkey, 3, CASE p_partkey % 4 WHEN 2 THEN concat(p_name, ' 本店') ELSE '' END FROM {part}
      UNION ALL SELECT p_partkey, 4, '#1' FROM {part} UNION ALL SELECT p_partkey, 5, '12,345円' FROM {part}
      UNION ALL SELECT p_partkey, 6, concat(p_name, ' 支店') FROM {part}""")
    return receipts.extract(lines).select(F.col("doc_id").alias("p_partkey"), F.col("storeName").alias("store"))


# --- text -------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name || ' #' || p_size AS text FROM part")
def normalize_width(spark, sf_dir):
    wide = run_sql(spark, sf_dir, "SELECT p_partkey, concat(p_name, ' #', p_size) AS s FROM {part}").withColumn("s", F.translate("s", text.HALF_ASCII, text.FULL_ASCII))
    return wide.select("p_partkey", text.halfwidth_ascii(F.col("s")).alias("text"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ギョウザ' WHEN 1 THEN 'パン・コーヒー' WHEN 2 THEN 'ヴァイオリン' WHEN 3 THEN '゛ア゜' ELSE '「ガ」。' END || p_partkey AS text FROM part""")
def normalize_kana(spark, sf_dir):
    half = run_sql(spark, sf_dir, "SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN 'ｷﾞｮｳｻﾞ' WHEN 1 THEN 'ﾊﾟﾝ･ｺｰﾋｰ' WHEN 2 THEN 'ｳﾞｧｲｵﾘﾝ' WHEN 3 THEN 'ﾞｱﾟ' ELSE '｢カﾞ｣｡' END, p_partkey) AS s FROM {part}")
    return half.select("p_partkey", text.normalize(F.col("s")).alias("text"))


@query("SELECT p_partkey, p_name || ' x' || chr(10) || p_type AS text FROM part")
def collapse_whitespace(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "SELECT p_partkey, concat('  ', replace(p_name, ' ', ' \\t　 '), '　x　\\n\\t', p_type, ' ') AS s FROM {part}")
    return rows.select("p_partkey", text.collapse_whitespace(F.col("s")).alias("text"))


@query("SELECT doc_id, replace(replace(text, chr(10), '<br>'), '|', '\\|') AS cell FROM documents")
def escape_cell(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.escape_cell(F.col("text")).alias("cell"))


@query("SELECT p_partkey, p_name AS name, p_name || ' ' AS stripped, p_type || chr(10) || 'x' AS trimmed FROM part")
def name_cleanup(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "SELECT p_partkey, concat('＊ ', p_name, ' ・・・:*') AS a, concat(p_name, ' ', p_size % 100, ' %') AS b, concat(p_type, '\\nx\\n\\n') AS c FROM {part}")
    return rows.select("p_partkey", text.trim_name(F.col("a")).alias("name"), text.strip_rates(F.col("b")).alias("stripped"), text.trim_trailing_newlines(F.col("c")).alias("trimmed"))


# --- numbers, dates ---------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN l_partkey WHEN 1 THEN l_suppkey ELSE -l_partkey END AS amount FROM lineitem""")
def amount_parse(spark, sf_dir):
    rows = run_sql(spark, sf_dir, """
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN concat('計 ￥', l_partkey, ' 番号 ', l_suppkey)
        WHEN 1 THEN concat(l_partkey, ' と ', l_suppkey) ELSE concat('▲', l_partkey, '円 99') END AS s FROM {lineitem}""")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.parse_amount(F.col("s")).alias("amount"))


@query("""
SELECT p_partkey, 1::BIGINT AS n, (1000 + p_partkey) AS amount, true AS marked FROM part
UNION ALL SELECT p_partkey, 2, -p_size::BIGINT, false FROM part UNION ALL SELECT p_partkey, 3, p_size::BIGINT, true FROM part""")
def amount_all(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "SELECT p_partkey, concat('¥', format_number(1000 + p_partkey, 0), ' a - ', p_size, ' b ', p_size, ' 円 99999999999999999999') AS s FROM {part}")
    out = rows.select("p_partkey", F.posexplode(numbers.amounts(F.col("s"))).alias("i", "m"))
    return out.select("p_partkey", (F.col("i") + 1).cast("long").alias("n"), "m.amount", "m.marked")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1000 + p_partkey WHEN 1 THEN -p_partkey END AS amount FROM part")
def standalone_amount(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(' ¥ ', format_number(1000 + p_partkey, 0), '円 ') WHEN 1 THEN concat('−', p_partkey) ELSE concat('計', p_partkey) END AS s FROM {part}")
    return rows.select("p_partkey", numbers.standalone_amount(F.col("s")).alias("amount"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 4 WHEN 0 THEN l_partkey WHEN 1 THEN l_partkey * 10000 + l_suppkey
  WHEN 2 THEN (l_suppkey % 9 + 1) * 1000 + (l_partkey % 9 + 1) * 100 + 10 + l_linenumber ELSE NULL END AS value FROM lineitem""")
def kanji_number(spark, sf_dir):
    rows = run_sql(spark, sf_dir, """
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, translate(CASE l_partkey % 4 WHEN 0 THEN CAST(l_partkey AS STRING) WHEN 1 THEN concat(CASE WHEN l_partkey = 1 THEN '' ELSE CAST(l_partkey AS STRING) END, '万', l_suppkey)
        WHEN 2 THEN concat(l_suppkey % 9 + 1, '千', l_partkey % 9 + 1, '百十', l_linenumber) ELSE concat(l_partkey, '円') END, '0123456789', '〇一二三四五六七八九') AS s FROM {lineitem}""")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.kanji_number(F.col("s")).alias("value"))


DATE_TEXTS = {
    "date_parse_era": "concat('発行 平成', year(o_orderdate) - 1988, '年 ', month(o_orderdate), '月', day(o_orderdate), '日')",
    "date_parse_long": "concat('No.1 ', year(o_orderdate), CASE o_orderkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '/' ELSE '．' END, month(o_orderdate), '.', day(o_orderdate))",
}


def _date_query(name, expression):
    def run(spark, sf_dir):
        return run_sql(spark, sf_dir, f"SELECT o_orderkey, {expression} AS s FROM {{orders}}").select("o_orderkey", dates.parse_date(F.col("s")).alias("date"))

    run.__name__ = name
    query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")(run)


for _name, _expression in DATE_TEXTS.items():
    _date_query(_name, _expression)


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS date FROM orders")
def date_parse_short(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "SELECT o_orderkey, concat('日付', lpad(year(o_orderdate) - 1980, 2, '0'), '/', lpad(month(o_orderdate), 2, '0'), '/', day(o_orderdate), ' x') AS s FROM {orders}")
    return rows.select("o_orderkey", dates.parse_date(F.col("s")).alias("date"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2020-02-29' WHEN o_orderkey % 3 = 1 THEN NULL ELSE '2003-04-05' END AS date FROM orders")
def date_invalid(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '令和2年2月29日' WHEN 1 THEN '2100-02-29' ELSE '平成15/13/1 2003.4.5' END AS s FROM {orders}")
    return rows.select("o_orderkey", dates.parse_date(F.col("s")).alias("date"))


@query("SELECT event_id, strftime(ts, '%H:%M') AS time FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1")
def time_parse(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('時刻 ', hour(ts), '：', lpad(minute(ts), 2, '0'), ' x') ELSE concat('2', event_id % 6 + 4, ':00') END AS s FROM {events}")
    return rows.select("event_id", dates.parse_time(F.col("s")).alias("time"))


# --- geometry ---------------------------------------------------------------------------------

PAIRS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS ax, CAST(l_linenumber AS DOUBLE) AS ay, CAST(l_partkey % 17 AS DOUBLE) AS aw, CAST(l_suppkey % 5 AS DOUBLE) AS ah, CAST(l_partkey % 40 AS DOUBLE) AS bx, CAST(l_suppkey % 7 AS DOUBLE) AS b_y, CAST(16 AS DOUBLE) AS bw, CAST(4 AS DOUBLE) AS bh FROM {lineitem}"


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) AS overlap,
       CASE WHEN least(aw, bw) > 0 THEN greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) / least(aw, bw) ELSE 0 END AS ratio,
       greatest(0, greatest(ay, b_y) - least(ay + ah, b_y + bh)) AS gap, ax <= bx + bw AND bx <= ax + aw AND ay <= b_y + bh AND b_y <= ay + ah AS touches, aw * ah AS area
FROM ({bare(PAIRS)})""")
def bbox_overlap(spark, sf_dir):
    c = F.col
    p = run_sql(spark, sf_dir, PAIRS)
    xs = (c("ax"), c("ax") + c("aw"), c("bx"), c("bx") + c("bw"))
    a, b = geometry.edges(c("ax"), c("ay"), c("aw"), c("ah")), geometry.edges(c("bx"), c("b_y"), c("bw"), c("bh"))
    return p.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geometry.overlap(*xs).alias("overlap"), geometry.overlap_ratio(*xs).alias("ratio"),
        geometry.gap(c("ay"), c("ay") + c("ah"), c("b_y"), c("b_y") + c("bh")).alias("gap"), geometry.intersects(a, b).alias("touches"), a["area"].alias("area"),
    )


@query("SELECT l_orderkey AS page_id, min(l_quantity) AS x, min(l_linenumber)::DOUBLE AS y, max(l_quantity + 5) - min(l_quantity) AS width, (max(l_linenumber) - min(l_linenumber) + 1)::DOUBLE AS height FROM lineitem GROUP BY l_orderkey")
def bbox_union(spark, sf_dir):
    c = F.col
    p = run_sql(spark, sf_dir, "SELECT l_orderkey AS page_id, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y, CAST(5 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS h FROM {lineitem}")
    return p.groupBy("page_id").agg(*geometry.union_box(c("x"), c("y"), c("w"), c("h")))


@query("""
WITH i AS (SELECT l_orderkey AS page_id, l_quantity AS lo, l_quantity + l_linenumber AS hi FROM lineitem),
p AS (SELECT DISTINCT a.page_id, a.hi AS lo FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.page_id = a.page_id AND b.lo <= a.hi AND b.hi > a.hi))
SELECT p.page_id, p.lo, min(i.lo) AS hi FROM p JOIN i ON p.page_id = i.page_id AND i.lo > p.lo GROUP BY ALL""")
def interval_gaps(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "SELECT l_orderkey AS page_id, l_quantity AS lo, l_quantity + l_linenumber AS hi FROM {lineitem}")
    return geometry.interval_gaps(rows, ["page_id"])


#: Intervals ten long that stand near multiples of nine: those of one number overlap by more than half,
#: those of neighbouring numbers by three at most.
JITTERED = "SELECT l_orderkey AS page_id, CAST(l_linenumber * 9 + l_partkey % 3 AS DOUBLE) AS lo, CAST(l_linenumber * 9 + l_partkey % 3 + 10 AS DOUBLE) AS hi, l_partkey AS id, l_linenumber AS n FROM {lineitem}"


@query(f"""
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::BIGINT AS band, min(lo) AS lo, max(hi) AS hi, count(*)::BIGINT AS n_members, sum(id)::BIGINT AS ids FROM ({bare(JITTERED)}) GROUP BY page_id, n""")
def interval_bands(spark, sf_dir):
    members = layout.interval_bands(run_sql(spark, sf_dir, JITTERED))
    out = members.groupBy("page_id", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n_members"), F.sum("id").alias("ids"))
    return out.withColumn("band", F.col("band").cast("long"))


@query(ORACLES["interval_bands"])
def interval_bands_column(spark, sf_dir):
    """The same as an array expression."""
    held = run_sql(spark, sf_dir, JITTERED).groupBy("page_id").agg(geometry.bands(F.collect_list(F.struct("lo", "hi", "id")), 0.5).alias("b"))
    out = held.select("page_id", F.posexplode("b").alias("band", "b"))
    ids = F.aggregate("b.members", F.lit(0).cast("long"), lambda n, m: n + m["id"])
    return out.select("page_id", F.col("band").cast("long").alias("band"), "b.lo", "b.hi", F.size("b.members").cast("long").alias("n_members"), ids.alias("ids"))


#: Boxes scattered over a sheet of each supplier, one in fifty of them large.
SCATTERED = """
SELECT l_suppkey AS page_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS BIGINT) AS obs_id,
       CAST(l_orderkey * 37 % 4000 AS DOUBLE) AS x, CAST(l_partkey * 53 % 4000 AS DOUBLE) AS y,
       CAST(CASE WHEN l_orderkey % 50 = 0 THEN 900 ELSE l_quantity END AS DOUBLE) AS width, CAST(CASE WHEN l_orderkey % 50 = 0 THEN 300 ELSE l_linenumber * 8 END AS DOUBLE) AS height
FROM {lineitem}"""


@query(f"""
WITH s AS ({bare(SCATTERED)})
SELECT a.page_id, a.obs_id, count(*)::BIGINT AS n_touching, sum(b.obs_id)::BIGINT AS ids FROM s a JOIN s b
ON a.page_id = b.page_id AND a.obs_id <> b.obs_id AND a.x <= b.x + b.width AND b.x <= a.x + a.width AND a.y <= b.y + b.height AND b.y <= a.y + a.height GROUP BY a.page_id, a.obs_id""")
def touching_boxes(spark, sf_dir):
    rows = run_sql(spark, sf_dir, SCATTERED)
    pairs = boxes.touching(rows, rows, unit=16.0).where(F.col("a.obs_id") != F.col("b.obs_id"))
    return pairs.groupBy("page_id", F.col("a.obs_id").alias("obs_id")).agg(F.count("*").alias("n_touching"), F.sum("b.obs_id").alias("ids"))


SHAPES = "SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS obs_id, 'x' AS text, l_quantity AS x, l_quantity AS y, CAST(l_partkey % 20 AS DOUBLE) AS width, CAST(l_suppkey % 20 AS DOUBLE) AS height, l_discount AS confidence FROM {lineitem}"


@query(f"""
SELECT page_id, CASE WHEN sum(CASE WHEN width > 0 AND height >= 1.6 * width THEN width * height ELSE 0 END) > sum(CASE WHEN height > 0 AND width >= 1.6 * height THEN width * height ELSE 0 END)
  THEN 'vertical' ELSE 'horizontal' END AS orientation FROM ({bare(SHAPES)}) GROUP BY page_id""")
def orientation_vote(spark, sf_dir):
    return layout.vote_orientation(run_sql(spark, sf_dir, SHAPES))


@query(f"SELECT page_id, obs_id, CASE WHEN width <= 0 OR height <= 0 THEN NULL WHEN width >= 1.6 * height THEN 'horizontal' WHEN height >= 1.6 * width THEN 'vertical' END AS region FROM ({bare(SHAPES)})")
def classify_region(spark, sf_dir):
    return run_sql(spark, sf_dir, SHAPES).select("page_id", "obs_id", geometry.classify_region(F.col("width"), F.col("height")).alias("region"))


@query(f"SELECT page_id, obs_id, confidence FROM ({bare(SHAPES)}) WHERE confidence >= 0.05")
def confidence_filter(spark, sf_dir):
    return layout.confident(run_sql(spark, sf_dir, SHAPES), layout.LayoutOptions(min_confidence=0.05)).select("page_id", "obs_id", "confidence")


# --- layout -----------------------------------------------------------------------------------

NUMBERED = "SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS k, l_partkey AS part, CAST(l_quantity AS BIGINT) AS qty FROM {lineitem}"
#: Two columns of two-fragment lines; every third page is written vertically, its axes swapped and
#: its columns running from the right.
FRAGMENTS = f"""
SELECT page_id, obs_id, text, CASE WHEN page_id % 3 = 0 THEN 2000 - v - 16 ELSE u END AS x, CASE WHEN page_id % 3 = 0 THEN u ELSE v END AS y,
       CASE WHEN page_id % 3 = 0 THEN CAST(16 AS DOUBLE) ELSE w END AS width, CASE WHEN page_id % 3 = 0 THEN w ELSE CAST(16 AS DOUBLE) END AS height, conf AS confidence FROM (
  SELECT page_id, k * 2 AS obs_id, concat('P', CAST(part AS STRING)) AS text, CAST(10 + 400 * (k % 2) AS DOUBLE) AS u, CAST(30 * (k - k % 2) / 2 AS DOUBLE) AS v, CAST(100 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS conf FROM ({NUMBERED})
  UNION ALL SELECT page_id, k * 2 + 1, concat('¥', CAST(qty AS STRING)), CAST(130 + 400 * (k % 2) AS DOUBLE), CAST(30 * (k - k % 2) / 2 AS DOUBLE) + 0.5, CAST(60 AS DOUBLE), CAST(0.5 AS DOUBLE) FROM ({NUMBERED}))"""
#: Lines in reading order: by column in horizontal pages; in vertical ones the upper section first.
ORDERED = f"SELECT page_id, part, qty, k, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k % 2, k) - 1 AS BIGINT) AS line_no, k % 2 AS col FROM ({NUMBERED})"


def fragments(spark, sf_dir):
    return run_sql(spark, sf_dir, FRAGMENTS)


@query(f"""
SELECT page_id, 'P' || part || '¥' || qty AS text, 'P' || part || ' ¥' || qty AS spaced_text, CASE WHEN page_id % 3 = 0 THEN 'vertical' ELSE 'horizontal' END AS orientation,
       CASE WHEN page_id % 3 = 0 THEN 16.5 ELSE 180 END::DOUBLE AS width, 0.75::DOUBLE AS confidence, 2::BIGINT AS n_obs, k * 2 AS first_obs FROM ({bare(NUMBERED)})""")
def line_cluster(spark, sf_dir):
    rows = layout.with_orientation(fragments(spark, sf_dir), layout.DEFAULT)
    return layout.cluster_lines(rows).select("page_id", "text", "spaced_text", "orientation", "width", "confidence", "n_obs", "first_obs")


@query(f"SELECT page_id, (k % 2)::BIGINT AS part_no, count(*)::BIGINT AS n_lines, min(k) * 2 AS first_obs FROM ({bare(NUMBERED)}) GROUP BY page_id, k % 2")
def block_cluster(spark, sf_dir):
    rows = layout.with_orientation(fragments(spark, sf_dir), layout.DEFAULT)
    blocks = layout.cluster_blocks(layout.cluster_lines(rows)).groupBy("page_id", "block").agg(F.count("*").alias("n_lines"), F.min("first_obs").alias("first_obs"))
    return blocks.select("page_id", (F.col("first_obs") / 2 % 2).cast("long").alias("part_no"), "n_lines", "first_obs")


@query(f"SELECT page_id, line_no, col::BIGINT AS block_no, 'P' || part || '¥' || qty AS text FROM ({bare(ORDERED)})")
def reading_order(spark, sf_dir):
    lines = layout.analyze(fragments(spark, sf_dir))
    return lines.select("page_id", F.col("line_no").cast("long").alias("line_no"), F.col("block_no").cast("long").alias("block_no"), "text")


@query(f"""
WITH b AS (SELECT page_id, col, string_agg('P' || part || '¥' || qty, chr(10) ORDER BY line_no) AS t FROM ({bare(ORDERED)}) GROUP BY page_id, col),
d AS (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY col) AS t FROM b GROUP BY page_id)
SELECT o_orderkey AS page_id, coalesce(t, '') AS text, CASE WHEN t IS NOT NULL AND o_orderkey % 3 = 0 THEN 'vertical' ELSE 'horizontal' END AS orientation FROM orders LEFT JOIN d ON o_orderkey = d.page_id""")
def layout_markdown(spark, sf_dir):
    pages = run_sql(spark, sf_dir, "SELECT o_orderkey AS page_id FROM {orders}")
    return layout.documents(layout.analyze(fragments(spark, sf_dir)), pages).select("page_id", "text", "orientation")


#: All orders on two sheets, one of them vertical: a stripe of a sheet for each order.
SHEETS = f"""
SELECT CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS page_id, CAST(page_id * 16 + obs_id AS INT) AS obs_id, text, confidence, width, height, CASE WHEN page_id % 3 = 0 THEN 'vertical' ELSE 'horizontal' END AS orientation,
       CASE WHEN page_id % 3 = 0 THEN x - page_id * 500 ELSE x END AS x, CASE WHEN page_id % 3 = 0 THEN y ELSE y + page_id * 500 END AS y FROM ({FRAGMENTS})"""


@query(f"""
SELECT CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS page_id, 'P' || part || '¥' || qty AS text, 'P' || part || ' ¥' || qty AS spaced_text, CASE WHEN page_id % 3 = 0 THEN 16.5 ELSE 180 END::DOUBLE AS width,
       0.75::DOUBLE AS confidence, 2::BIGINT AS n_obs, (page_id * 16 + k * 2)::INT AS first_obs FROM ({bare(NUMBERED)})""")
def line_cluster_sheets(spark, sf_dir):
    """Lines of pages that hold all boxes of the table, spread over all tasks."""
    return bigpages.cluster_lines(run_sql(spark, sf_dir, SHEETS)).select("page_id", "text", "spaced_text", "width", "confidence", "n_obs", "first_obs")


@query(f"""
SELECT CASE WHEN own % 3 = 0 THEN 0 ELSE 1 END AS page_id, n_lines, first_obs, n_lines - 1 AS last_place
FROM (SELECT page_id AS own, count(*)::BIGINT AS n_lines, min(page_id * 16 + k * 2)::INT AS first_obs FROM ({bare(NUMBERED)}) GROUP BY page_id, k % 2)""")
def block_cluster_sheets(spark, sf_dir):
    blocks = bigpages.cluster_blocks(bigpages.cluster_lines(run_sql(spark, sf_dir, SHEETS)))
    out = blocks.groupBy("page_id", "block").agg(F.count("*").alias("n_lines"), F.min("first_obs").alias("first_obs"), F.max("in_block").alias("last_place"))
    return out.select("page_id", "n_lines", "first_obs", "last_place")


# --- tables -----------------------------------------------------------------------------------

#: Three columns per lineitem row; every third row has no middle cell, every fourth a wide first cell
#: over two columns; rows are jittered by a pixel.
GRID = f"""
SELECT page_id, k * 3 + c AS obs_id, concat('c', CAST(k AS STRING), '.', CAST(c AS STRING), '|', CAST(part AS STRING)) AS text, CAST(c * 100 + k % 2 AS DOUBLE) AS x, CAST(k * 40 + c % 2 AS DOUBLE) AS y,
       CASE WHEN c = 0 AND k % 4 = 3 THEN CAST(160 AS DOUBLE) ELSE CAST(60 AS DOUBLE) END AS width, CAST(20 AS DOUBLE) AS height, CAST(1 AS DOUBLE) AS confidence
FROM (SELECT page_id, k, part, 0 AS c FROM ({NUMBERED}) UNION ALL SELECT page_id, k, part, 1 FROM ({NUMBERED}) WHERE k % 3 <> 2 AND k % 4 <> 3 UNION ALL SELECT page_id, k, part, 2 FROM ({NUMBERED}))"""


@query(f"SELECT page_id, k::BIGINT AS row, c::BIGINT AS col, 1::BIGINT AS row_span, CASE WHEN c = 0 AND k % 4 = 3 THEN 2 ELSE 1 END::BIGINT AS col_span, text FROM (SELECT *, (obs_id - obs_id % 3) / 3 AS k, obs_id % 3 AS c FROM ({bare(GRID)}))")
def table_cells(spark, sf_dir):
    cells, _ = tables.reconstruct(run_sql(spark, sf_dir, GRID))
    return cells.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("row", "col", "row_span", "col_span")], "text")


_ROW = "'| ' || replace(coalesce(max(text) FILTER (WHERE c = 0), ''), '|', '\\|') || ' | ' || replace(coalesce(max(text) FILTER (WHERE c = 1), ''), '|', '\\|') || ' | ' || replace(coalesce(max(text) FILTER (WHERE c = 2), ''), '|', '\\|') || ' |'"


def _tables(spark, sf_dir):
    """Cells and sizes of the tables of all orders, those without a box included."""
    return Engine(lambda images: run_sql(spark, sf_dir, GRID)).table(_orders(spark, sf_dir))


@query(f"""
WITH g AS (SELECT *, (obs_id - obs_id % 3) / 3 AS k, obs_id % 3 AS c FROM ({bare(GRID)})), r AS (SELECT page_id, k, {_ROW} AS line FROM g GROUP BY page_id, k),
m AS (SELECT page_id, string_agg(CASE WHEN k = 0 THEN line || chr(10) || '| --- | --- | --- |' ELSE line END, chr(10) ORDER BY k) AS markdown FROM r GROUP BY page_id)
SELECT o_orderkey AS page_id, coalesce(markdown, '') AS markdown FROM orders LEFT JOIN m ON o_orderkey = m.page_id""")
def table_markdown(spark, sf_dir):
    grid = tables.grids(*_tables(spark, sf_dir))
    return grid.select("page_id", render.table_markdown(F.col("grid")).alias("markdown"))


@query(f"""
WITH g AS (SELECT page_id, max((obs_id - obs_id % 3) / 3)::BIGINT + 1 AS n, count(*) AS n_texts FROM ({bare(GRID)}) GROUP BY page_id)
SELECT o_orderkey AS page_id, coalesce(n, 0)::BIGINT AS n_rows, CASE WHEN n IS NULL THEN 0 ELSE 3 END::BIGINT AS n_cols, coalesce(n_texts, 0)::BIGINT AS n_texts FROM orders LEFT JOIN g ON o_orderkey = g.page_id""")
def table_grid(spark, sf_dir):
    grid = tables.grids(*_tables(spark, sf_dir))
    texts = F.size(F.filter(F.flatten("grid"), lambda t: t != ""))
    width = F.coalesce(F.size(F.get("grid", F.lit(0))), F.lit(0))
    return grid.select("page_id", F.size("grid").cast("long").alias("n_rows"), F.greatest(width, F.lit(0)).cast("long").alias("n_cols"), texts.cast("long").alias("n_texts"))


@query(f"SELECT DISTINCT page_id, text FROM ({bare(GRID)}) WHERE obs_id = 9")
def table_cell_covering(spark, sf_dir):
    cells, sizes = tables.reconstruct(run_sql(spark, sf_dir, GRID))
    at = sizes.select("page_id", F.lit(3).alias("at_row"), F.lit(1).alias("at_col"))
    return tables.cells_covering(cells, at).select("page_id", "text")


# --- decoding, backends -----------------------------------------------------------------------

VOCABULARY = "_あいうえおかきくけこさしすせ"


def logits():
    """Four steps of sixteen classes from each embedding."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.slice("embedding", t * 16 + 1, 16))


_STEPS = "SELECT vec_id, t, list_max(s) AS p, list_position(s, list_max(s)) - 1 AS c FROM (SELECT vec_id, t, embedding[t * 16 + 1:t * 16 + 16] AS s FROM embeddings, range(0, 4) AS r(t))"
_EMITTED = f"SELECT *, c <> 0 AND (before IS NULL OR before <> c) AS emitted FROM (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM ({_STEPS}))"


@query(f"""
SELECT vec_id, coalesce(string_agg(CASE WHEN c < 15 THEN substr('_あいうえおかきくけこさしすせ', c::INT + 1, 1) ELSE '' END, '' ORDER BY t) FILTER (WHERE emitted), '') AS text,
       round(CASE WHEN count(*) FILTER (WHERE emitted) = 0 THEN 0 ELSE least(greatest(avg(p::DOUBLE) FILTER (WHERE emitted), 0), 1) END, 6) AS confidence FROM ({_EMITTED}) GROUP BY vec_id""")
def ctc_decode(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", ctc.decode_logits(logits(), F.split(F.lit(VOCABULARY), "")).alias("d"))
    return rows.select("vec_id", "d.text", F.round("d.confidence", 6).alias("confidence"))


@query(f"SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY t) - 1)::BIGINT AS n, c::BIGINT AS label FROM ({_EMITTED}) WHERE emitted")
def ctc_labels(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode(ctc.greedy_labels(logits())).alias("n", "label"))
    return rows.select("vec_id", F.col("n").cast("long").alias("n"), F.col("label").cast("long").alias("label"))


@query("""
SELECT p.page_id, p.page_id * 10 + o.k AS obs_id, o.text FROM pages p JOIN (SELECT 0 AS k, 'receipt' AS name, 'a' AS text UNION ALL SELECT 1, 'receipt', 'b' UNION ALL SELECT 0, 'table', 'c') o
ON o.name = CASE p.page_id % 3 WHEN 0 THEN 'receipt' WHEN 1 THEN 'table' ELSE 'unknown' END""")
def backend_route(spark, sf_dir):
    named = spark.createDataFrame([("receipt", 0, "a"), ("receipt", 1, "b"), ("table", 0, "c")], "name string, obs_id int, text string")
    named = named.select("name", "obs_id", "text", *[F.lit(0.0).alias(c) for c in backends.FIELDS[1:]])
    images = run_sql(spark, sf_dir, "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'receipt' WHEN 1 THEN 'table' ELSE 'unknown' END AS name FROM {pages}")
    found = backends.by_name(named)(images)
    return found.select("page_id", (F.col("page_id") * 10 + F.col("obs_id")).alias("obs_id"), "text")


@query(f"SELECT page_id, line_no, col::BIGINT AS block_no, 'P' || part || '¥' || qty AS text FROM ({bare(ORDERED)}) WHERE page_id > 100 AND page_id % 3 <> 0")
def observation_files(spark, sf_dir):
    """Pages written as files of observations and read back by the data source, which is asked for some pages
    and sure boxes only."""
    pagefiles.register(spark)
    box = F.struct("text", "x", "y", "width", "height", "confidence")
    boxes_of = F.transform(F.array_sort(F.collect_list(F.struct("obs_id", box.alias("box")))), lambda b: b["box"])
    pages = fragments(spark, sf_dir).groupBy("page_id").agg(boxes_of.alias("boxes"))
    path = f"{shared.folder(spark)}/kamishi/observations-{uuid.uuid4().hex}"
    pages.select(F.to_json(F.struct("page_id", "boxes")).alias("value")).write.text(path)
    read = spark.read.format("observations").load(path).where("page_id > 100 AND confidence >= 0.5")
    lines = layout.analyze(read.where("page_id % 3 <> 0"))
    return lines.select("page_id", F.col("line_no").cast("long").alias("line_no"), F.col("block_no").cast("long").alias("block_no"), "text")


@query("SELECT page_id, 'page ' || page_id || chr(10) || url AS markdown FROM pages")
def page_file_sink(spark, sf_dir):
    """Markdown of every page written as a file of its own, and read back from there."""
    pagefiles.register(spark)
    rows = run_sql(spark, sf_dir, "SELECT page_id, posexplode(array(concat('page ', page_id), url)) AS (obs_id, text) FROM {pages}")
    placed = rows.select("page_id", "obs_id", "text", F.lit(10.0).alias("x"), (F.col("obs_id") * 20.0).alias("y"), F.lit(300.0).alias("width"), F.lit(16.0).alias("height"), F.lit(1.0).alias("confidence"))
    shown = Engine(lambda images: placed).markdown(run_sql(spark, sf_dir, "SELECT page_id FROM {pages}"))
    path = f"{shared.folder(spark)}/kamishi/pages-{uuid.uuid4().hex}"
    shown.withColumnRenamed("markdown", "content").write.format("page_files").option("suffix", "md").mode("append").save(path)
    back = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return back.select(F.regexp_extract("name", r"^(.+)[.]md$", 1).cast("long").alias("page_id"), F.col("value").alias("markdown"))


_BOX = "(width / 64) * 640 AS x, (1 - height / 32 - height / 32) * 320 AS y, (width / 64) * 640 AS w, (height / 32) * 320 AS h"


@query(f"""
SELECT page_id, obs_id, x, y, px, py, least(640 - px, w * 1.5) AS pw, least(320 - py, h * 1.5) AS ph
FROM (SELECT *, greatest(x - w * 0.25, 0) AS px, greatest(y - h * 0.25, 0) AS py FROM (SELECT page_id, obs_id, {_BOX} FROM ({bare(SHAPES)})))""")
def box_conversion(spark, sf_dir):
    c, one = F.col, F.lit
    rows = run_sql(spark, sf_dir, SHAPES)
    box = backends.from_normalized(c("width") / 64, c("height") / 32, c("width") / 64, c("height") / 32, one(640.0), one(320.0))
    padded = backends.padded_region(box["x"], box["y"], box["width"], box["height"], one(640.0), one(320.0), 0.25)
    return rows.select("page_id", "obs_id", box["x"].alias("x"), box["y"].alias("y"), *[padded[k].alias(v) for k, v in (("x", "px"), ("y", "py"), ("width", "pw"), ("height", "ph"))])


CANDIDATES = "SELECT l_orderkey AS page_id, l_linenumber AS obs_id, l_partkey AS part, l_suppkey AS supp, l_quantity AS qty, l_partkey % 3 AS rank, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('t', CAST(l_partkey AS STRING)) END AS text FROM {lineitem}"


@query(f"SELECT page_id, obs_id, part, supp, qty, text FROM ({bare(CANDIDATES)}) WHERE rank = 0 AND text <> ''")
def top_candidates(spark, sf_dir):
    return backends.top_candidates(run_sql(spark, sf_dir, CANDIDATES))


@query(f"SELECT page_id, obs_id, CASE WHEN width > 0 AND height >= 1.6 * width THEN 'clockwise' ELSE 'none' END AS turn FROM ({bare(SHAPES)})")
def crop_rotation(spark, sf_dir):
    rows = run_sql(spark, sf_dir, SHAPES)
    return rows.select("page_id", "obs_id", backends.rotation(geometry.classify_region(F.col("width"), F.col("height")), "clockwise").alias("turn"))


@query(f"""
SELECT page_id, obs_id, least(width, height) AS lo, greatest(width, height) AS hi, abs(width - height) AS length, (width + height) / 2 AS center,
       least(width, height, x) AS union_lo, greatest(width, height, x + 3) AS union_hi FROM ({bare(SHAPES)})""")
def interval_fields(spark, sf_dir):
    i = geometry.interval(F.col("width"), F.col("height"))
    m, u = geometry.interval_measures(i), geometry.interval_union(i, geometry.interval(F.col("x") + 3, F.col("x")))
    return run_sql(spark, sf_dir, SHAPES).select("page_id", "obs_id", i["lo"].alias("lo"), i["hi"].alias("hi"), *[v.alias(k) for k, v in m.items()], u["lo"].alias("union_lo"), u["hi"].alias("union_hi"))


@query("SELECT o_orderkey AS page_id, coalesce(max(l_quantity + l_linenumber) - min(l_quantity), 0)::DOUBLE AS extent FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def interval_extent(spark, sf_dir):
    rows = run_sql(spark, sf_dir, "SELECT o_orderkey AS page_id, l_quantity AS lo, l_quantity + l_linenumber AS hi FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey")
    return rows.groupBy("page_id").agg(geometry.extent(F.col("lo"), F.col("hi")).cast("double").alias("extent"))


#: Boxes that share a point, so that no projection gap parts them.
CROSSED = "SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS item, 'horizontal' AS orientation, CAST(-(l_partkey % 7) AS DOUBLE) AS x, CAST(-(l_suppkey % 5) AS DOUBLE) AS y, CAST(40 AS DOUBLE) AS width, CAST(30 AS DOUBLE) AS height FROM {lineitem}"


@query(f"SELECT page_id, item, (row_number() OVER (PARTITION BY page_id ORDER BY y, x, item) - 1)::INT AS rank FROM ({bare(CROSSED)})")
def fallback_order(spark, sf_dir):
    return layout.reading_order(run_sql(spark, sf_dir, CROSSED))


@query(f"SELECT page_id, text, CASE WHEN k % 4 = 3 THEN 2 ELSE 1 END::BIGINT AS col_span FROM (SELECT *, (obs_id - obs_id % 3) / 3 AS k FROM ({bare(GRID)})) WHERE obs_id = 9")
def table_cell_at(spark, sf_dir):
    cells, _ = tables.reconstruct(run_sql(spark, sf_dir, GRID))
    return tables.cell_at(cells, 3, 0).select("page_id", "text", F.col("col_span").cast("long").alias("col_span"))


@query("""
SELECT vec_id, t, c::BIGINT AS class, round(a * (1 - w) + b * w, 6) AS value FROM (
  SELECT vec_id, t, c, pos - floor(pos) AS w, embedding[floor(pos)::INT * 16 + 1 + c]::DOUBLE AS a, embedding[least(floor(pos) + 1, 3)::INT * 16 + 1 + c]::DOUBLE AS b
  FROM (SELECT vec_id, embedding, t, c, greatest((t + 0.5) * 4 / 6.0 - 0.5, 0) AS pos FROM embeddings, range(0, 6) AS r(t), range(0, 16) AS s(c)))""")
def ctc_align(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode(ctc.align_timesteps(logits(), 6)).alias("t", "step"))
    rows = rows.select("vec_id", F.col("t").cast("long").alias("t"), F.posexplode("step").alias("class", "value"))
    return rows.select("vec_id", "t", F.col("class").cast("long").alias("class"), F.round(F.col("value").cast("double"), 6).alias("value"))


# --- the engine -------------------------------------------------------------------------------

def _orders(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT o_orderkey AS page_id, 'order' AS name FROM {orders}")


@query(f"""
WITH s AS ({bare(SUMS)})
SELECT o_orderkey AS doc_id, 'スーパー カワサキ' || o_custkey || '号店' AS store, strftime(o_orderdate, '%Y-%m-%d') AS date, s.total, s.total + 1000 AS tendered, coalesce(s.n_items, 0) AS n_items
FROM orders LEFT JOIN s ON o_orderkey = s.doc_id""")
def engine_receipt(spark, sf_dir):
    """Receipt lines as boxes, the store's name the tallest, through layout and extraction."""
    lines = receipt_lines(spark, sf_dir)
    tall = F.when(F.col("line_no") == 0, 30.0).otherwise(16.0)
    boxes = lines.select(F.col("doc_id").alias("page_id"), F.col("line_no").alias("obs_id"), F.col("line").alias("text"), F.lit(10.0).alias("x"), (F.col("line_no") * 40.0).alias("y"), F.lit(200.0).alias("width"), tall.alias("height"), F.lit(1.0).alias("confidence"))
    found = Engine(lambda images: boxes, layout.RECEIPT).receipt(_orders(spark, sf_dir))
    return found.select("doc_id", F.col("storeName").alias("store"), "date", "total", "tendered", F.size("items").cast("long").alias("n_items"))


@query(ORACLES["layout_markdown"].replace("AS text,", "AS markdown,").rsplit(", CASE", 1)[0] + " FROM orders LEFT JOIN d ON o_orderkey = d.page_id")
def engine_markdown(spark, sf_dir):
    return Engine(lambda images: fragments(spark, sf_dir)).markdown(_orders(spark, sf_dir))


@query(f"""
WITH g AS (SELECT *, (obs_id - obs_id % 3) / 3 AS k FROM ({bare(GRID)})),
n AS (SELECT page_id, max(k)::BIGINT + 1 AS row_count, count(*) AS n_cells, string_agg(text, ' ' ORDER BY obs_id) AS texts FROM g GROUP BY page_id)
SELECT o_orderkey AS page_id, coalesce(row_count, 0)::BIGINT AS row_count, CASE WHEN row_count IS NULL THEN 0 ELSE 3 END::BIGINT AS column_count, coalesce(n_cells, 0)::BIGINT AS n_cells, coalesce(texts, '') AS texts
FROM orders LEFT JOIN n ON o_orderkey = n.page_id""")
def engine_table(spark, sf_dir):
    cells, sizes = _tables(spark, sf_dir)
    held = cells.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "text"))).alias("cs"))
    texts = F.coalesce(F.array_join(F.transform("cs", lambda c: c["text"]), " "), F.lit(""))
    n_cells = F.coalesce(F.array_size("cs"), F.lit(0)).cast("long")
    return sizes.join(held, "page_id", "left").select("page_id", F.col("row_count").cast("long").alias("row_count"), F.col("column_count").cast("long").alias("column_count"), n_cells.alias("n_cells"), texts.alias("texts"))


@query(f"""
WITH l AS (
  SELECT page_id, col, line_no, CASE WHEN page_id % 3 = 0 THEN 'vertical' ELSE 'horizontal' END AS turn,
         '{{"boundingBox":{{"height":' || CASE WHEN page_id % 3 = 0 THEN '180.0' ELSE '16.5' END || ',"width":' || CASE WHEN page_id % 3 = 0 THEN '16.5' ELSE '180.0' END || ',"x":' ||
         CASE WHEN page_id % 3 = 0 THEN 2000 - 30 * ((k - col) / 2)::DOUBLE - 16.5 ELSE 10 + 400 * col END::DOUBLE || ',"y":' || CASE WHEN page_id % 3 = 0 THEN 10 + 400 * col ELSE 30 * ((k - col) / 2) END::DOUBLE ||
         '}},"confidence":0.75,"text":"P' || part || '¥' || qty || '"}}' AS j FROM ({bare(ORDERED)})),
b AS (SELECT page_id, col, turn, '{{"lines":[' || string_agg(j, ',' ORDER BY line_no) || '],"orientation":"' || turn || '"}}' AS j FROM l GROUP BY page_id, col, turn),
d AS (SELECT page_id, '{{"blocks":[' || string_agg(j, ',' ORDER BY col) || '],"orientation":"' || turn || '"}}' AS json FROM b GROUP BY page_id, turn)
SELECT o_orderkey AS page_id, coalesce(json, '{{"blocks":[],"orientation":"horizontal"}}') AS json FROM orders LEFT JOIN d ON o_orderkey = d.page_id""")
def layout_json(spark, sf_dir):
    return Engine(lambda images: fragments(spark, sf_dir)).json(_orders(spark, sf_dir), pretty=False)


@query(f"""
WITH g AS (SELECT *, (obs_id - obs_id % 3) / 3 AS k, obs_id % 3 AS c FROM ({bare(GRID)})),
j AS (
  SELECT page_id, '{{"cells":[' || string_agg('{{"boundingBox":{{"height":20.0,"width":' || width || ',"x":' || x || ',"y":' || y || '}},"column":' || c::INT || ',"columnSpan":' || CASE WHEN c = 0 AND k % 4 = 3 THEN 2 ELSE 1 END ||
         ',"row":' || k::INT || ',"rowSpan":1,"text":"' || text || '"}}', ',' ORDER BY k, c) || '],"columnCount":3,"rowCount":' || (max(k)::INT + 1) || '}}' AS json FROM g GROUP BY page_id)
SELECT o_orderkey AS page_id, coalesce(json, '{{"cells":[],"columnCount":0,"rowCount":0}}') AS json FROM orders LEFT JOIN j ON o_orderkey = j.page_id""")
def table_json(spark, sf_dir):
    return render.table_json(*_tables(spark, sf_dir), pretty=False)


@query(ORACLES["reading_order"])
def sql_page_lines(spark, sf_dir):
    """The reading order by SQL: one table function, which takes some pages at a time."""
    sql.register(spark)
    lines = spark.sql("SELECT * FROM page_lines(TABLE(SELECT * FROM {boxes}) PARTITION BY (page_id div 1000))", boxes=fragments(spark, sf_dir))
    return lines.select("page_id", F.col("line_no").cast("long").alias("line_no"), F.col("block_no").cast("long").alias("block_no"), "text")


@query(f"""
SELECT 'p' || page_id AS page_id, line_no, 'P' || part AS text FROM (
  SELECT page_id, part, row_number() OVER (PARTITION BY page_id ORDER BY k - k % 2, k % 2) - 1 AS line_no FROM ({bare(NUMBERED)}) WHERE page_id % 3 <> 0)""")
def sql_page_lines_options(spark, sf_dir):
    """Pages named by strings, and layout options: only sure boxes, lines of any gap along a row, one block."""
    sql.register(spark)
    rows = fragments(spark, sf_dir).where("page_id % 3 <> 0").withColumn("page_id", F.concat(F.lit("p"), F.col("page_id")))
    lines = spark.sql("""SELECT page_id, block_no, line_no, text FROM page_lines_by_name(TABLE(SELECT * FROM {boxes}) PARTITION BY (left(page_id, greatest(length(page_id) - 3, 1))), '{{"min_confidence": 0.75, "orientation": "horizontal", "line_gap_factor": 0.5, "block_overlap": 0.0, "block_gap_factor": 9.0}}')""", boxes=rows)
    return lines.select("page_id", F.col("line_no").cast("long").alias("line_no"), "text")


@query("SELECT p_partkey, p_name || ' x' || chr(10) || p_type AS text, p_name AS name, p_name || ' ' AS stripped, 'a<br>b\\|' AS cell, 'ギ' || p_partkey || ' a' AS kana, 'A!' || p_size AS ascii, CASE WHEN p_size >= 16 THEN 'horizontal' WHEN p_size <= 6 THEN 'vertical' END AS region, least(p_size, 10) / least(p_size, 20)::DOUBLE AS ratio, greatest(0, p_size - 20)::DOUBLE AS gap FROM part")
def sql_scalars(spark, sf_dir):
    """The scalar functions by SQL; Catalyst inlines their bodies."""
    sql.register(spark)
    return run_sql(spark, sf_dir, """
      SELECT p_partkey, collapse_whitespace(concat('  ', replace(p_name, ' ', ' \\t　 '), '　x　\\n\\t', p_type, ' ')) AS text, trim_name(concat('＊ ', p_name, ' ・・・:*')) AS name,
             strip_rates(concat(p_name, ' ', p_size % 100, ' %')) AS stripped, escape_cell('a\\nb|') AS cell, normalize_text(concat(fullwidth_kana('ｷﾞ'), p_partkey, '　ａ ')) AS kana, halfwidth_ascii(concat('Ａ！', p_size)) AS ascii,
             classify_region(p_size, 10) AS region, overlap_ratio(0, p_size, CASE WHEN p_size > 10 THEN p_size - 10 ELSE 0 END, CASE WHEN p_size > 10 THEN p_size + 10 ELSE 20 END) AS ratio, interval_gap(0, 20, p_size, 60) AS gap FROM {part}""")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN l_partkey WHEN 1 THEN l_suppkey ELSE -l_partkey END AS amount,
       2::BIGINT AS n_amounts, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey WHEN l_partkey % 3 = 1 THEN l_suppkey ELSE 99 END AS last, -l_suppkey AS solo FROM lineitem""")
def sql_amounts(spark, sf_dir):
    sql.register(spark)
    return run_sql(spark, sf_dir, """
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, parse_amount(s) AS amount, CAST(size(amounts(s)) AS BIGINT) AS n_amounts, element_at(amounts(s), -1).amount AS last, standalone_amount(concat(' -', l_suppkey, '円')) AS solo
      FROM (SELECT *, CASE l_partkey % 3 WHEN 0 THEN concat('計 ￥', l_partkey, ' 番号 ', l_suppkey) WHEN 1 THEN concat(l_partkey, ' と ', l_suppkey) ELSE concat('▲', l_partkey, '円 99') END AS s FROM {lineitem})""")


KANJI = "translate(CASE l_partkey % 4 WHEN 0 THEN CAST(l_partkey AS STRING) WHEN 1 THEN concat(CASE WHEN l_partkey = 1 THEN '' ELSE CAST(l_partkey AS STRING) END, '万', l_suppkey) WHEN 2 THEN concat(l_suppkey % 9 + 1, '千', l_partkey % 9 + 1, '百十', l_linenumber) ELSE concat(l_partkey, '円') END, '0123456789', '〇一二三四五六七八九')"


@query(ORACLES["kanji_number"])
def sql_kanji_number(spark, sf_dir):
    sql.register(spark)
    return run_sql(spark, sf_dir, f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kanji_number({KANJI}) AS value FROM {{lineitem}}")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS era, strftime(o_orderdate, '%Y-%m-%d') AS long, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS short, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30' AS time
FROM orders""")
def sql_dates(spark, sf_dir):
    sql.register(spark)
    short = "concat('日付', lpad(year(o_orderdate) - 1980, 2, '0'), '/', month(o_orderdate), '/', day(o_orderdate), ' x')"
    return run_sql(spark, sf_dir, f"""
      SELECT o_orderkey, parse_date({DATE_TEXTS['date_parse_era']}) AS era, parse_date({DATE_TEXTS['date_parse_long']}) AS long, parse_date({short}) AS short, parse_time(concat('時刻', o_orderkey % 24, '：30')) AS time FROM {{orders}}""")
