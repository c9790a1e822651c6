"""Numbers and yen amounts as Column expressions. `\\d` is ASCII; overflow gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, let, normalize

# How amounts are written.
AMOUNT = r"([¥￥\\])?\s*([-−▲△])?\s*(\d{1,3}(?:,\d{3})+|\d+)\s*(円)?"
LONE_AMOUNT = r"\A\s*([¥￥\\])?\s*([-−▲△])?(\d{1,3}(?:,\d{3})+|\d+)\s*(円)?\s*\z"
MARKS, MINUS = ["¥", "￥", "\\", "円"], ["-", "−", "▲", "△"]

# Numerals by value and units by size.
KANJI_DIGITS, OTHER_ZERO = "〇一二三四五六七八九", "零"
SMALL_UNITS = {"十": 10, "百": 100, "千": 1000}
LARGE_UNITS = {"万": 10_000, "億": 100_000_000, "兆": 1_000_000_000_000}


def _unit(c: Column, units: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for name, size in units.items():
        out = F.when(c == name, F.lit(size).cast("long")).otherwise(out)
    return out


#: A numeral with its units in falling order, each at most once: four sections of up to four runs of digits.
_SECTION = "(?:([0-9]+)千)?(?:([0-9]+)百)?(?:([0-9]+)十)?([0-9]+)?"
IN_ORDER = rf"\A(?:{_SECTION}兆)?(?:{_SECTION}億)?(?:{_SECTION}万)?(?:{_SECTION})?\z"


def _folded(s: Column) -> Column:
    """Value of digits and units in any order: digits extend the current run, a small unit moves it to
    the section, a large unit closes the section. A unit without a number counts once."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("current"))

    def step(a, c):
        digit = F.when(c.between("0", "9"), F.ascii(c) - 48).cast("long")
        small, large = _unit(c, SMALL_UNITS), _unit(c, LARGE_UNITS)
        once = lambda n: F.when(n == 0, F.lit(1).cast("long")).otherwise(n)
        whole = F.try_add(a["section"], a["current"])
        return F.struct(
            F.when(large.isNotNull(), F.try_add(a["total"], F.try_multiply(once(whole), large))).otherwise(a["total"]).alias("total"),
            F.when(large.isNotNull(), zero).when(small.isNotNull(), F.try_add(a["section"], F.try_multiply(once(a["current"]), small))).otherwise(a["section"]).alias("section"),
            F.when(digit.isNotNull(), F.try_add(F.try_multiply(a["current"], F.lit(10).cast("long")), digit)).otherwise(zero).alias("current"),
        )

    return F.aggregate(F.split(s, ""), start, step, lambda a: F.try_add(F.try_add(a["total"], a["section"]), a["current"]))


def kanji_number(s: Column) -> Column:
    """Value of a numeral in kanji or digits; null if anything else is in it.

    A unit without a number counts once, so a 1 is put before it. A numeral whose units fall is then cut
    into its sixteen runs of digits by one pattern, and the runs times their units are added up; any other
    order of units is left to a fold over the characters.
    """
    s = F.translate(s, KANJI_DIGITS + OTHER_ZERO, "01234567890")
    ones = F.when(s.rlike("[十百千万億兆]"), F.regexp_replace(s, "(?<![0-9])0*(?=[十百千])|(?<![0-9十百千])0*(?=[万億兆])", "1")).otherwise(s)
    runs = F.split(F.when(s.rlike("[0-9十百千万億兆]") & ones.rlike(IN_ORDER), F.regexp_replace(ones, IN_ORDER, ",".join(f"${i}" for i in range(1, 17)))), ",", -1)
    value = None
    for i in range(16):  # '0' in front reads an absent run as 0
        unit = F.lit([1000, 100, 10, 1][i % 4] * [10**12, 10**8, 10**4, 1][i // 4]).cast("long")
        term = F.try_multiply(F.concat(F.lit("0"), runs[i]).try_cast("long"), unit)
        value = term if value is None else F.try_add(value, term)
    return F.coalesce(value, F.when(s.rlike(r"\A[0-9十百千万億兆]+\z"), _folded(s)))


def read_amount(match: Column) -> Column:
    """struct<amount, marked, digits> of one matched amount, marks and signs around digits; amount is null on overflow."""
    digits = F.replace(F.btrim(match, F.lit("".join(MARKS + MINUS) + " \t\n\x0b\f\r")), F.lit(","), F.lit(""))

    def read(d):
        value = d.try_cast("long")
        return F.struct(F.when(contains_any(match, MINUS), -value).otherwise(value).alias("amount"), contains_any(match, MARKS).alias("marked"), F.char_length(d).alias("digits"))

    return let(digits, read)


def matches(s: Column) -> Column:
    """array<string>: the amounts of a normalized text as they are written."""
    return F.when(s.rlike(r"\d"), F.regexp_extract_all(s, F.lit(AMOUNT), F.lit(0))).otherwise(F.when(s.isNotNull(), F.array().cast("array<string>")))


def read_all(found: Column) -> Column:
    read = F.transform(found, read_amount)
    return F.transform(F.filter(read, lambda r: r["amount"].isNotNull()), lambda r: F.struct(r["amount"].alias("amount"), r["marked"].alias("marked")))


def amounts(s: Column, normalized: bool = False) -> Column:
    """array<struct<amount long, marked boolean>> in order of appearance."""
    return read_all(matches(s) if normalized else let(normalize(s), matches))


def last_amount(found: Column) -> Column:
    """The last marked amount of amounts(), else the last."""
    return F.coalesce(F.try_element_at(F.filter(found, lambda m: m["marked"]), F.lit(-1))["amount"], F.try_element_at(found, F.lit(-1))["amount"])


def last_of(found: Column) -> Column:
    """last_amount() of matches(); the others are read only where the last one does not decide."""
    sure = lambda r: F.when(r["amount"].isNotNull() & (r["marked"] | (F.size(found) == 1)), r["amount"]).when(F.size(found) > 1, let(read_all(found), last_amount))
    return let(F.try_element_at(found, F.lit(-1)), lambda m: F.when(m.isNotNull(), let(read_amount(m), sure)))


def parse_amount(s: Column, normalized: bool = False) -> Column:
    return let(matches(s) if normalized else let(normalize(s), matches), last_of)


def standalone_amount(s: Column) -> Column:
    """Value of a line that is nothing but an amount; null otherwise."""
    return F.when(s.rlike(LONE_AMOUNT), read_amount(s)["amount"])
