"""Receipts: typed fields of (doc_id, line_no, line) rows by windows over the lines of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date, parse_time
from ..functions.numbers import amounts, last_of, matches, read_amount, standalone_amount
from ..functions.text import collapse_whitespace, contains_any, let, normalize, strip_rates, trim_name

# Keywords of receipts, and how prices and unit prices are written.
TOTAL_WORDS = ["合計", "総計", "お会計", "ご請求"]
TAX_WORDS = ["消費税", "内税", "外税"]
STORE_STOPS = ["TEL", "Tel", "tel", "電話", "FAX", "〒", "領収", "レシート", "レジ", "ありがとう", "ございま", "いらっしゃい", "ようこそ", "またお越し", "担当", "責任者", "店番", "No.", "NO.", "#", "会員", "ポイント"]
NOISE = ["TEL", "Tel", "tel", "電話", "FAX", "〒", "レジ", "領収", "レシート", "ありがとう", "ございま", "いらっしゃい", "またお越し", "ポイント", "会員", "カード", "取引", "端末", "No.", "NO."]
PRICE = r"([¥￥\\])?\s*([-−▲△])?(\d{1,3}(?:,\d{3})+|\d+)\s*(円)?"
UNIT_PRICE = r"@\s*\d{1,3}(?:,\d{3})*"
MAX_PRICE, STORE_LINES, HINT_LINES = 10_000_000, 6, 5
MONEY = ["tendered", "change", "subtotal", "total"]


def is_tax_line(s: Column) -> Column:
    return (s.contains("対象") & s.rlike(r"\d{1,2}\s*%")) | contains_any(s, TAX_WORDS)


def line_kind(s: Column) -> Column:
    """The first keyword that applies decides."""
    tendered = contains_any(s, ["お預", "預り", "預かり"])
    return (
        F.when(tendered, "tendered").when(contains_any(s, ["釣", "おつり"]), "change").when(s.contains("小計"), "subtotal")
        .when(is_tax_line(s), "tax").when(contains_any(s, TOTAL_WORDS), "total").when(s.contains("点数"), "count").otherwise("item")
    )


def is_plausible_store(s: Column, date: Column, time: Column, solo: Column | None = None) -> Column:
    """solo: the line's standalone amount, where it is known already."""
    solo = standalone_amount(s) if solo is None else solo
    return (s != "") & date.isNull() & time.isNull() & solo.isNull() & ~contains_any(s, STORE_STOPS)


def parse_tax_line(s: Column) -> Column:
    """struct<isReducedRate, rate, taxAmount, taxableAmount>."""
    taxable = s.contains("対象")

    def read(found):
        first, last = F.try_element_at(found, F.lit(1))["amount"], F.try_element_at(found, F.lit(-1))["amount"]
        both = taxable & s.contains("税") & (F.size(found) >= 2)
        return F.struct(
            contains_any(s, ["軽減", "※"]).alias("isReducedRate"),
            F.regexp_extract(s, r"(\d{1,2})\s*%", 1).try_cast("long").alias("rate"),
            F.when(both | ~taxable, last).alias("taxAmount"),
            F.when(both, first).when(taxable, last).alias("taxableAmount"),
        )

    return let(amounts(strip_rates(s), True), read)


def merge_tax_lines(lines: Column) -> Column:
    """One entry per rate (null is a rate), in order of appearance; first known amounts win."""

    def merged(rate):
        own = F.filter(lines, lambda t: t["rate"].eqNullSafe(rate))
        first = lambda f: F.try_element_at(F.filter(F.transform(own, lambda t: t[f]), lambda v: v.isNotNull()), F.lit(1))
        return F.struct(F.exists(own, lambda t: t["isReducedRate"]).alias("isReducedRate"), rate.alias("rate"), first("taxAmount").alias("taxAmount"), first("taxableAmount").alias("taxableAmount"))

    return F.transform(F.array_distinct(F.transform(lines, lambda t: t["rate"])), merged)


def parse_item(s: Column) -> Column:
    """struct<name, price, quantity> of a line that ends in a price, else null."""
    bare_end = lambda x: F.when(x.endswith(" ") | x.endswith("\t"), F.rtrim(x, F.lit(" \t"))).otherwise(x)
    found = lambda p, *words: F.when(contains_any(s, words), F.regexp_extract(s, p, 0)).otherwise("")
    times, pieces = found(r"[x×]\s*(\d+)", "x", "×"), found(r"(\d+)\s*[個点]", "個", "点")

    def without_unit_prices(left):
        # they go one by one until none is left; each takes an @ with it, so there are no more passes than that
        at = F.char_length(left) - F.char_length(F.replace(left, F.lit("@"), F.lit("")))
        bare = F.aggregate(F.sequence(F.lit(1), at), left, lambda x, _: F.regexp_replace(x, rf"(?s)\A(.*?){UNIT_PRICE}", "$1"))
        return let(F.when(left.contains("@"), bare).otherwise(left), bare_end)

    # a pattern's first match is also the first place of its text
    rest = lambda q: F.when(q != "", F.overlay(s, F.lit(""), F.instr(s, q), F.char_length(q))).otherwise(s)

    def read(p):
        """p: the line without quantity and unit price, its last amount and what that says, and how the quantity is written."""
        name = trim_name(F.substring(p["left"], F.lit(1), F.char_length(p["left"]) - F.char_length(p["whole"])))
        quantity = F.when(p["q"] != "", F.regexp_extract(p["q"], r"\d+", 0)).try_cast("long")
        named = lambda x: (x != "") & x.rlike(r"[^\p{N}〇零一二三四五六七八九十百千万億兆]")
        ok = F.endswith(p["left"], p["whole"]) & (p["a"]["marked"] | (p["a"]["digits"] >= 2)) & (F.abs(p["a"]["amount"]) <= MAX_PRICE)
        return F.when(ok, let(name, lambda x: F.when(named(x), F.struct(x.alias("name"), p["a"]["amount"].alias("price"), quantity.alias("quantity")))))

    priced = lambda x: let(F.try_element_at(F.regexp_extract_all(x, F.lit(PRICE), F.lit(0)), F.lit(-1)), bare_end)
    parts = lambda x, q: let(priced(x), lambda w: F.struct(x.alias("left"), w.alias("whole"), read_amount(w).alias("a"), q.alias("q")))
    split = lambda q: let(without_unit_prices(rest(q)), lambda x: let(parts(x, q), read))
    return F.when(s.rlike(r"\d"), let(let(times, lambda t: F.when(t != "", t).otherwise(pieces)), split))


def read_lines(lines: DataFrame, *carried: str) -> DataFrame:
    """What each line says on its own: norm, date, time, kind, amount (of lines that name one of MONEY), solo; and the
    columns carried on."""
    n = F.col("norm")
    out = lines.select("doc_id", "line_no", *carried, normalize(F.col("line")).alias("norm")).withColumn("norm", collapse_whitespace(n))
    out = out.withColumns({"date": parse_date(n, True), "time": parse_time(n, True), "kind": F.when(n != "", line_kind(n)), "solo": standalone_amount(n)})
    out = out.withColumn("found", F.when(F.col("kind").isin(MONEY), let(strip_rates(n), matches)))
    return out.withColumn("amount", last_of(F.col("found"))).drop("found")


def classify_lines(lines: DataFrame, *carried: str) -> DataFrame:
    """read_lines() with what earlier lines decide: target and value of amounts, items, tax lines."""
    rows = read_lines(lines, *carried)
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    kind, n = F.col("kind"), F.col("norm")
    pending = F.when(kind.isin(MONEY) & F.col("amount").isNull(), kind)
    summary = kind.isin([*MONEY, "tax"])
    # one exchange, by doc_id, and one order serve all windows
    rows = rows.withColumns({
        "pending": F.last(F.when(n != "", F.struct(pending.alias("kind"))), ignorenulls=True).over(before)["kind"],  # of the last line before that is not empty
        "closed": F.coalesce(F.max(F.when(summary, True).otherwise(False)).over(before), F.lit(False)),
        "n_lines": F.count("*").over(doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "stopped": F.max(contains_any(n, ["合計", "小計"])).over(doc.rowsBetween(Window.unboundedPreceding, 0)),
    })
    taken = F.col("pending").isNotNull() & F.col("solo").isNotNull() & (n != "")
    rows = rows.withColumns({
        "taken": taken,
        "target": F.when(taken, F.col("pending")).when(kind.isin(MONEY) & F.col("amount").isNotNull(), kind),
        "value": F.when(taken, F.col("solo")).otherwise(F.col("amount")),
    })
    may = ~F.col("taken") & (kind == "item") & ~F.col("closed") & ~contains_any(n, NOISE) & ((F.col("line_no") > 0) | (F.col("n_lines") == 1)) & F.col("date").isNull()
    return rows.withColumns({
        "item": F.when(may, parse_item(n)),
        "tax": F.when(~F.col("taken") & (kind == "tax"), parse_tax_line(n)),
        "counted": F.when(~F.col("taken") & (kind == "count"), F.regexp_extract(n, r"(\d+)\s*点?", 1).try_cast("long")),
    })


def extract(lines: DataFrame, hints: DataFrame | str | None = None) -> DataFrame:
    """One receipt per doc_id of (doc_id, line_no, line); hints (doc_id, hint) names a store line, as does a column of
    lines of that name, which holds the same on every line of a document."""
    if isinstance(hints, str):
        rows = classify_lines(lines, hints).withColumnRenamed(hints, "hint")
    else:
        rows = classify_lines(lines)
        rows = rows.withColumn("hint", F.lit(None).cast("int")) if hints is None else rows.join(hints, "doc_id", "left")
    no = F.col("line_no")
    first = lambda c, cond: F.min_by(c, F.when(cond, no))
    last = lambda c, cond: F.max_by(c, F.when(cond, no))
    in_order = lambda c, cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("line_no", F.col(c).alias("v"))))), lambda r: r["v"])
    early = (no < STORE_LINES) & ~F.col("stopped")
    plausible = is_plausible_store(F.col("norm"), F.col("date"), F.col("time"), F.col("solo"))
    rows = rows.withColumn("plausible", F.when(early | (no == F.col("hint")), plausible))
    store_line, hinted = F.col("plausible") & early, F.col("plausible") & (no == F.col("hint"))
    out = rows.groupBy("doc_id").agg(
        last("value", F.col("target") == "change").alias("change"),
        first("date", F.col("date").isNotNull()).alias("date"),
        last("counted", F.col("counted").isNotNull()).alias("declaredItemCount"),
        in_order("item", F.col("item").isNotNull()).alias("items"),
        in_order("norm", F.lit(True)).alias("rawLines"),
        F.coalesce(first("norm", hinted), first("norm", store_line)).alias("storeName"),
        last("value", F.col("target") == "subtotal").alias("subtotal"),
        in_order("tax", F.col("tax").isNotNull()).alias("taxLines"),
        last("value", F.col("target") == "tendered").alias("tendered"),
        first("time", F.col("time").isNotNull()).alias("time"),
        last("value", F.col("target") == "total").alias("total"),
    )
    return out.withColumn("taxLines", merge_tax_lines(F.col("taxLines")))


def items_total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, i: a + i["price"])
