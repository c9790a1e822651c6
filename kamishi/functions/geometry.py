"""Boxes and intervals as Column arithmetic. A box is (x, y, width, height), top-left, y down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE = 1.6


def overlap(lo_a, hi_a, lo_b, hi_b) -> Column:
    return F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))


def gap(lo_a, hi_a, lo_b, hi_b) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(lo_a, lo_b) - F.least(hi_a, hi_b))


def overlap_ratio(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Overlap over the shorter side; 0 where that has no length."""
    side = F.least(hi_a - lo_a, hi_b - lo_b)
    return F.when(side > 0, overlap(lo_a, hi_a, lo_b, hi_b) / side).otherwise(0.0)


def edges(x: Column, y: Column, width: Column, height: Column) -> dict[str, Column]:
    """Derived coordinates of a box."""
    return {"min_x": x, "max_x": x + width, "mid_x": x + width / 2, "min_y": y, "max_y": y + height, "mid_y": y + height / 2, "area": width * height}


def union_box(x, y, width, height) -> list[Column]:
    """Aggregates: the box around a group's boxes."""
    return [F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x + width) - F.min(x)).alias("width"), (F.max(y + height) - F.min(y)).alias("height")]


def box_or_zero(rows: Column) -> Column:
    """struct<x, y, width, height> around an array of boxes, zero where it is empty."""
    at = lambda f, use: F.coalesce(use(F.transform(rows, f)), F.lit(0.0))
    x, y = at(lambda b: b["x"], F.array_min), at(lambda b: b["y"], F.array_min)
    right, bottom = at(lambda b: b["x"] + b["width"], F.array_max), at(lambda b: b["y"] + b["height"], F.array_max)
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height"))


def intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Touching counts."""
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])


def interval(a: Column, b: Column) -> Column:
    """struct<lo, hi>, bounds in order."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def interval_measures(i: Column) -> dict[str, Column]:
    """Length and centre of an interval."""
    return {"length": i["hi"] - i["lo"], "center": (i["lo"] + i["hi"]) / 2}


def interval_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))


def classify_region(width: Column, height: Column) -> Column:
    return F.when((width <= 0) | (height <= 0), None).when(width / height >= WIDE, "horizontal").when(height / width >= WIDE, "vertical")


def interval_gaps(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Uncovered stretches between the intervals (lo, hi) of each group: gaps and islands."""
    before = Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    seen = intervals.withColumn("_until", F.max("hi").over(before))
    return seen.where(F.col("lo") > F.col("_until")).select(*by, F.col("_until").alias("lo"), F.col("lo").alias("hi"))


def extent(lo: Column, hi: Column) -> Column:
    """Aggregate: from the least lower to the greatest upper bound, 0 without rows."""
    return F.coalesce(F.max(hi) - F.min(lo), F.lit(0.0))


def bands(intervals: Column, min_ratio: float) -> Column:
    """array<struct<lo, hi, members array<struct<lo, hi, id>>>> of array<struct<lo, hi, id>>.

    A fold in order of lo, hi, id: an interval joins the newest band that it overlaps and one of
    whose members it overlaps by min_ratio; bands never merge. Result in order of lo.
    """
    start = F.array().cast("array<struct<lo:double,hi:double,members:array<struct<lo:double,hi:double,id:bigint>>>>")
    ratio = lambda m, i: overlap_ratio(m["lo"], m["hi"], i["lo"], i["hi"])

    def step(acc, i):
        fits = lambda b: (overlap(b["lo"], b["hi"], i["lo"], i["hi"]) > 0) & F.exists(b["members"], lambda m: ratio(m, i) >= min_ratio)
        hits = F.filter(F.sequence(F.lit(1), F.size(acc)), lambda k: fits(acc[k - 1]))
        to = F.when(F.size(acc) > 0, F.array_max(hits))
        grown = lambda b: F.struct(F.least(b["lo"], i["lo"]).alias("lo"), F.greatest(b["hi"], i["hi"]).alias("hi"), F.concat(b["members"], F.array(i)).alias("members"))
        own = F.struct(i["lo"].alias("lo"), i["hi"].alias("hi"), F.array(i).alias("members"))
        return F.when(to.isNull(), F.concat(acc, F.array(own))).otherwise(F.transform(acc, lambda b, k: F.when(k == to - 1, grown(b)).otherwise(b)))

    return F.array_sort(F.aggregate(F.array_sort(intervals), start, step))
