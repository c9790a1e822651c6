"""Page kernels against plain loops, on pages of overlapping, tied, empty and far boxes."""

import random
from statistics import median

import pytest

from kamishi.operators import layout

OPTIONS = [
    layout.DEFAULT, layout.RECEIPT, layout.LayoutOptions(early_exit=False), layout.LayoutOptions(orientation="vertical", line_overlap=0.1, block_overlap=0.0, block_gap_factor=0.3),
    layout.LayoutOptions(line_gap_factor=0.2, min_confidence=0.3),
]


def ratio(a, b, c, d):
    side = min(b - a, d - c)
    return max(0.0, min(b, d) - max(a, c)) / side if side > 0 else 0.0


def apart(a, b, c, d):
    return max(0.0, max(a, c) - min(b, d))


def groups(n, edges):
    label = list(range(n))
    for a, b in edges:
        x, y = sorted((label[a], label[b]))
        label = [x if v == y else v for v in label]
    return label


def cut(items, vertical, box):
    """Items in reading order by recursive cuts."""
    if len(items) > 1:
        for axis in (1, 0) if vertical else (0, 1):
            spans = sorted((box(i)[axis], box(i)[axis] + box(i)[axis + 2], i) for i in items)
            need = 0.005 * (max(s[1] for s in spans) - spans[0][0])
            parts, until = [[]], spans[0][1]
            for lo, hi, i in spans:
                if lo > until and lo - until >= need:
                    parts.append([])
                parts[-1].append(i)
                until = max(until, hi)
            if len(parts) > 1:
                if vertical and axis == 0:
                    parts.reverse()
                return [i for p in parts for i in cut(p, vertical, box)]
    middle = lambda i: (box(i)[1] + box(i)[3] / 2, (box(i)[0] + box(i)[2] / 2) * (-1 if vertical else 1), i)
    return sorted(items, key=middle)


def plain(rows, o):
    """[(block_no, line_no, orientation, text, spaced_text, x, y, width, height)] of one page."""
    rows = [r for r in rows if r["confidence"] >= o.min_confidence]
    if not rows:
        return []
    area = lambda cond: sum(r["w"] * r["h"] for r in rows if r["w"] > 0 and r["h"] > 0 and cond(r["w"], r["h"]))
    vertical = o.orientation == "vertical" if o.orientation else area(lambda w, h: h / w >= 1.6) > area(lambda w, h: w / h >= 1.6)
    name = "vertical" if vertical else "horizontal"

    def spans(b):
        r, c = (b["x"], b["x"] + b["w"]), (b["y"], b["y"] + b["h"])
        return (*c, *r) if vertical else (*r, *c)

    rows = sorted(rows, key=lambda r: (spans(r)[0], r["obs"]))
    edges = []
    for i, a in enumerate(rows):
        s, e, lo, hi = spans(a)
        for j in range(i + 1, len(rows)):
            s2, e2, lo2, hi2 = spans(rows[j])
            reach = float("inf") if o.line_gap_factor is None else o.line_gap_factor * max(hi - lo, hi2 - lo2)
            if ratio(lo, hi, lo2, hi2) >= o.line_overlap and apart(s, e, s2, e2) <= reach:
                edges.append((i, j))
            if o.early_exit and s2 > e + reach:
                break
    found = {}
    for r, k in zip(rows, groups(len(rows), edges), strict=True):
        found.setdefault(k, []).append(r)
    lines = []
    for members in found.values():
        x, y = min(r["x"] for r in members), min(r["y"] for r in members)
        w, h = max(r["x"] + r["w"] for r in members) - x, max(r["y"] + r["h"] for r in members) - y
        lines.append({"t": "".join(r["t"] or "" for r in members), "st": " ".join(r["t"] or "" for r in members), "x": x, "y": y, "w": w, "h": h, "first": min(r["obs"] for r in members)})
    lines.sort(key=lambda b: b["first"])
    far = o.block_gap_factor * median(spans(b)[3] - spans(b)[2] for b in lines)
    edges = []
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            (s, e, lo, hi), (s2, e2, lo2, hi2) = spans(a), spans(lines[j])
            if ratio(s, e, s2, e2) >= o.block_overlap and apart(lo, hi, lo2, hi2) <= far:
                edges.append((i, j))
    held = {}
    for b, k in zip(lines, groups(len(lines), edges), strict=True):
        held.setdefault(k, []).append(b)
    parts = sorted(held.values(), key=lambda p: p[0]["first"])

    def box(k):
        p = parts[k]
        x, y = min(b["x"] for b in p), min(b["y"] for b in p)
        return x, y, max(b["x"] + b["w"] for b in p) - x, max(b["y"] + b["h"] for b in p) - y

    out = []
    for no, k in enumerate(cut(list(range(len(parts))), vertical, box)):
        for b in sorted(parts[k], key=lambda b: (-(b["x"] + b["w"] / 2) if vertical else b["y"] + b["h"] / 2, b["first"])):
            out.append((no, len(out), name, b["t"], b["st"], b["x"], b["y"], b["w"], b["h"]))
    return out


def pages(seed):
    r = random.Random(seed)
    for page in range(60):
        crowd, tall = r.choice([1, 3, 12, 40]), r.random() < 0.4
        for obs in range(r.randint(1, crowd)):
            w, h = r.choice([0, 4, 10, 40]), r.choice([0, 4, 6, 10])
            yield page, obs, r.choice(["a", "字", "", None, "x y"]), r.randint(0, 12) * 8.0, r.randint(0, 12) * 5.0, float(h if tall else w), float(w if tall else h), r.choice([0.1, 0.5, 1.0])


@pytest.mark.parametrize("which", range(len(OPTIONS)))
def test_analyze_equals_loops(spark, which):
    o = OPTIONS[which]
    rows = list(pages(which))
    by_page = {}
    for page, obs, t, x, y, w, h, c in rows:
        by_page.setdefault(page, []).append({"obs": obs, "t": t, "x": x, "y": y, "w": w, "h": h, "confidence": c})
    random.Random(which).shuffle(rows)
    got = {}
    for r in layout.analyze(spark.createDataFrame(rows, layout.OBSERVATION), o).collect():
        got.setdefault(r.page_id, []).append((r.block_no, r.line_no, r.orientation, r.text, r.spaced_text, r.x, r.y, r.width, r.height))
    assert {p: sorted(v) for p, v in got.items()} == {p: v for p, v in ((p, plain(b, o)) for p, b in by_page.items()) if v}


def test_steps_agree_with_analyze(spark):
    """Lines, blocks and the order of their boxes one after the other give what analyze gives at once."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(list(pages(9)), layout.OBSERVATION)
    placed = layout.cluster_blocks(layout.cluster_lines(layout.with_orientation(docs, layout.DEFAULT)))
    box = [F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height")]
    blocks = placed.groupBy("page_id", "block").agg(F.first("orientation").alias("orientation"), F.min("first_obs").alias("item"), *box)
    ranks = blocks.select("page_id", "block", F.col("item").cast("long").alias("item")).join(layout.reading_order(blocks), ["page_id", "item"])
    steps = placed.join(ranks, ["page_id", "block"]).select("page_id", "rank", "in_block", "text").collect()
    whole = layout.analyze(docs).select("page_id", "block_no", "line_no", "text").collect()
    assert [x[:2] + x[3:] for x in sorted(map(tuple, steps))] == [x[:2] + x[3:] for x in sorted(map(tuple, whole), key=lambda x: (x[0], x[2]))]


def test_empty(spark):
    none = spark.createDataFrame([], layout.OBSERVATION)
    assert layout.analyze(none).count() == 0 and layout.cluster_lines(layout.with_orientation(none, layout.DEFAULT)).count() == 0
