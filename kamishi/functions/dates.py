"""Japanese dates and times as Column expressions. Dates are ISO strings: year 0 is a valid year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, let, normalize

# What is added to an era's year.
ERAS = {"令和": 2018, "㋿": 2018, "R": 2018, "平成": 1988, "㍻": 1988, "H": 1988, "昭和": 1925, "㍼": 1925, "S": 1925, "大正": 1911, "㍽": 1911, "T": 1911, "明治": 1867, "㍾": 1867, "M": 1867}
# How dates and times are written.
ERA_DATE = r"(令和|平成|昭和|大正|明治|㋿|㍻|㍼|㍽|㍾|[RHSTM])\s*(\d{1,2}|元)\s*[年.\-/]\s*(\d{1,2})\s*[月.\-/]\s*(\d{1,2})\s*日?"
LONG_DATE = r"(\d{4})\s*[年/\-.]\s*(\d{1,2})\s*[月/\-.]\s*(\d{1,2})\s*日?"
SHORT_DATE = r"(?:^|[^\d])(\d{2})[/.](\d{1,2})[/.](\d{1,2})(?:[^\d]|$)"
TIME = r"(\d{1,2}):(\d{2})"


def _int(s: Column) -> Column:
    return s.try_cast("int")


def days_in_month(year: Column, month: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31).otherwise(0)


def is_valid(year: Column, month: Column, day: Column) -> Column:
    return (day >= 1) & (day <= days_in_month(year, month))


def pad(value: Column, width: int) -> Column:
    text = value.cast("string")
    return F.when(F.char_length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def iso(year: Column, month: Column, day: Column) -> Column:
    """yyyy-mm-dd of a valid date, else null."""
    return F.when(is_valid(year, month, day), F.concat_ws("-", pad(year, 4), pad(month, 2), pad(day, 2)))


def gregorian_year(era: Column, year: Column) -> Column:
    offsets = F.create_map(*[F.lit(x) for pair in ERAS.items() for x in pair])
    return F.when(year >= 1, F.try_element_at(offsets, era) + year)


def parse_date(s: Column, normalized: bool = False) -> Column:
    """First era date, else four-digit year, else two-digit year; each tier looks at its first match.

    normalized: s is normalized text already (normalizing twice changes nothing but costs).
    """
    n = s if normalized else normalize(s)

    def tier(pattern, build):
        """build(groups) of the first match; the groups are read from the match, not from the line."""
        parts = lambda m: F.struct(*[F.regexp_extract(m, pattern, i).alias(f"g{i}") for i in range(1, 1 + pattern.count("(") - pattern.count("(?:"))])
        return let(F.regexp_extract(n, pattern, 0), lambda m: F.when(m != "", let(parts(m), build)))

    whole = lambda year, month, day: let(F.struct(year.alias("y"), _int(month).alias("m"), _int(day).alias("d")), lambda t: iso(t["y"], t["m"], t["d"]))
    era = tier(ERA_DATE, lambda g: whole(gregorian_year(g["g1"], F.when(g["g2"] == "元", 1).otherwise(_int(g["g2"]))), g["g3"], g["g4"]))
    long = tier(LONG_DATE, lambda g: whole(_int(g["g1"]), g["g2"], g["g3"]))
    short = tier(SHORT_DATE, lambda g: whole(2000 + _int(g["g1"]), g["g2"], g["g3"]))
    # dates of all three kinds have a mark with a digit behind it
    return F.when(contains_any(n, ["年", "/", ".", "-"]) & n.rlike(r"[年/.\-]\s*\d"), F.coalesce(era, long, short))


def parse_time(s: Column, normalized: bool = False) -> Column:
    """HH:MM of the first time, null if it is out of range."""
    n = s if normalized else normalize(s)
    read = lambda m: F.struct(_int(F.regexp_extract(m, TIME, 1)).alias("h"), _int(F.regexp_extract(m, TIME, 2)).alias("m"))
    shown = lambda t: F.when(t["h"].between(0, 23) & t["m"].between(0, 59), F.concat_ws(":", pad(t["h"], 2), pad(t["m"], 2)))
    return F.when(n.contains(":"), let(F.regexp_extract(n, TIME, 0), lambda m: F.when(m != "", let(read(m), shown))))


def ymd(date: Column) -> Column:
    """struct<day, month, year> of an ISO date."""
    part = lambda i: F.split(date, "-")[i].cast("long")
    return F.when(date.isNotNull(), F.struct(part(2).alias("day"), part(1).alias("month"), part(0).alias("year")))
