"""Bands, cells, lines of any gap and box joins against plain loops."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kamishi.functions import geometry
from kamishi.operators import boxes, layout, pagewise, tables


def hits_of(bands, lo, hi, ratio):
    out = []
    for k, (a, b) in enumerate(bands):
        side = min(b - a, hi - lo)
        if side > 0 and max(0.0, min(b, hi) - max(a, lo)) >= ratio * side:
            out.append(k)
    return out


def plain_bands(intervals, ratio):
    bands = []
    for _, lo, hi, _ in sorted((b - a, a, b, k) for k, (a, b) in enumerate(intervals)):
        hits = hits_of(bands, lo, hi, ratio)
        if not hits:
            bands.append((lo, hi))
        elif len(hits) == 1:
            a, b = bands[hits[0]]
            bands[hits[0]] = (min(a, lo), max(b, hi))
    return sorted(bands)


def plain_assign(bands, lo, hi, ratio):
    hits = hits_of(bands, lo, hi, ratio)
    if hits:
        return hits[0], hits[-1] - hits[0] + 1
    return min((abs((a + b) / 2 - (lo + hi) / 2), k) for k, (a, b) in enumerate(bands))[1], 1


def random_intervals(r, n, step=1):
    return [(a, a + r.choice([0, 1, 2, 3, 5, 8, 20, 60])) for a in (r.randint(0, 100) / step for _ in range(n))]


@pytest.mark.parametrize("ratio", [0.0, 0.3, 0.5, 1.0])
def test_bands_and_assignment(ratio):
    r = random.Random(int(ratio * 10))
    pages = [random_intervals(r, r.choice([1, 2, 7, 30, 90]), r.choice([1, 3])) for _ in range(25)]
    page = np.repeat(np.arange(25), [len(p) for p in pages])
    lo, hi = (np.array([i[k] for p in pages for i in p], float) for k in (0, 1))
    tie = np.array([k for p in pages for k in range(len(p))])
    found = pagewise.table_bands(page, lo, hi, tie, ratio)
    for k, p in enumerate(pages):
        assert [(a, b) for q, a, b in zip(*(x.tolist() for x in found), strict=True) if q == k] == plain_bands(p, ratio)
    first, span = pagewise.assign_bands(page, lo, hi, found, ratio)
    want = [plain_assign(plain_bands(p, ratio), *i, ratio) for p in pages for i in p]
    assert list(zip(first.tolist(), span.tolist(), strict=True)) == want


def test_assignment_in_parts(monkeypatch):
    """Few pairs at a time give the same; a wide interval meets many bands."""
    r = random.Random(4)
    intervals = [(k * 10.0, k * 10.0 + 6) for k in range(200)] + [(5.0, 1990.0), (6.0, 9.5), (-50.0, -40.0)] + random_intervals(r, 50)
    page, lo, hi = np.zeros(len(intervals), np.int64), *(np.array([i[k] for i in intervals], float) for k in (0, 1))
    bands = pagewise.table_bands(page, lo, hi, np.arange(len(lo)), 0.5)
    whole = pagewise.assign_bands(page, lo, hi, bands, 0.5)
    monkeypatch.setattr(pagewise, "PAIRS", 8)
    assert all((a == b).all() for a, b in zip(whole, pagewise.assign_bands(page, lo, hi, bands, 0.5), strict=True))


def test_cells_of_random_pages(spark):
    """Cells of whole pages against lines placed one by one."""
    r = random.Random(8)
    rows = [(p, k, f"t{k}", float(r.randint(0, 12) * 50 + r.randint(0, 9)), float(r.randint(0, 9) * 30 + r.randint(0, 5)), float(r.choice([20, 40, 120])), float(r.choice([10, 20, 70])), 1.0) for p in range(12) for k in range(r.choice([1, 4, 40]))]
    df = spark.createDataFrame(rows, layout.OBSERVATION)
    lines = layout.cluster_lines(df.withColumn("orientation", F.lit("horizontal")), tables.CELLS).collect()
    want, sizes = {}, {}
    for p in range(12):
        own = sorted((x for x in lines if x.page_id == p), key=lambda x: x.first_obs)
        rows_, cols = (plain_bands([(x[at], x[at] + x[side]) for x in own], 0.5) for at, side in (("y", "height"), ("x", "width")))
        sizes[p] = (len(rows_), len(cols))
        for x in sorted(own, key=lambda x: (x.y, x.x, x.first_obs)):
            i, j = plain_assign(rows_, x.y, x.y + x.height, 0.5), plain_assign(cols, x.x, x.x + x.width, 0.5)
            c = want.setdefault((p, i[0], j[0]), [0, 0, "", [], []])
            want[p, i[0], j[0]] = [max(c[0], i[1]), max(c[1], j[1]), c[2] + x.text, [*c[3], (x.x, x.x + x.width)], [*c[4], (x.y, x.y + x.height)]]
    cells, found = tables.reconstruct(df)
    got = {(c.page_id, c.row, c.col): (c.row_span, c.col_span, c.text, c.x, c.x + c.width, c.y, c.y + c.height) for c in cells.collect()}
    assert got == {k: (a, b, t, min(x[0] for x in xs), max(x[1] for x in xs), min(y[0] for y in ys), max(y[1] for y in ys)) for k, (a, b, t, xs, ys) in want.items()}
    assert {s.page_id: (s.row_count, s.column_count) for s in found.collect()} == sizes
    assert tables.reconstruct(df.limit(0))[0].count() == 0 and tables.reconstruct(df.limit(0))[1].count() == 0


def test_one_exchange_to_cells(spark):
    df = spark.createDataFrame([(1, 0, "a", 0.0, 0.0, 9.0, 9.0, 1.0)], layout.OBSERVATION)
    plan = tables.reconstruct(df)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_interval_bands(spark):
    r = random.Random(6)
    rows = [(p, float(a), float(b), k) for p in range(20) for k, (a, b) in enumerate(random_intervals(r, r.choice([1, 5, 25])))]
    df = spark.createDataFrame(rows, "page_id long, lo double, hi double, id long")
    for ratio in (0.3, 0.5, 1.0):
        held = df.groupBy("page_id").agg(geometry.bands(F.collect_list(F.struct("lo", "hi", "id")), ratio).alias("b")).collect()
        want = sorted((x.page_id, sorted(m.id for m in b.members)) for x in held for b in x.b)
        found = {}
        for x in layout.interval_bands(df, ratio).collect():
            found.setdefault((x.page_id, x.band), []).append(x.id)
        assert sorted((p, sorted(m)) for (p, _), m in found.items()) == want


def pairs_of(lo, hi, ratio):
    near = pagewise.overlap_ratio(lo[:, None], hi[:, None], lo, hi) >= ratio
    a, b = np.nonzero(near & ~np.eye(len(lo), dtype=bool))
    return pagewise.components(len(lo), a, b)


@pytest.mark.parametrize("ratio", [0.1, 0.4, 0.5, 0.9, 1.0])
def test_components_without_all_pairs(ratio):
    r = random.Random(int(ratio * 100))
    for _ in range(150):
        intervals = random_intervals(r, r.choice([1, 3, 12, 40]), r.choice([1, 2, 7]))
        lo, hi = (np.array([i[k] for i in intervals], float) for k in (0, 1))
        assert pagewise.aligned_components(lo, hi, ratio).tolist() == pairs_of(lo, hi, ratio).tolist()


def sheet(n, rows, r):
    row = np.array([r.randrange(rows) for _ in range(n)])
    f = {"obs_id": np.arange(n), "x": np.array([r.random() * 5000 for _ in range(n)]), "y": row * 30.0 + np.array([r.random() * 4 for _ in range(n)]), "width": np.full(n, 9.0), "height": np.full(n, 16.0), "confidence": np.ones(n)}
    import pyarrow as pa

    return f | {"text": pa.array(["a"] * n)}


def test_lines_of_any_gap(monkeypatch):
    """A large page gives the lines that comparing all pairs gives."""
    f = sheet(600, 25, random.Random(1))
    zeros = np.zeros(600, np.int64)
    fast = pagewise.lines(zeros, zeros > 0, f, layout.RECEIPT)
    monkeypatch.setattr(pagewise, "LONE_PAGE", 10**9)
    slow = pagewise.lines(zeros, zeros > 0, f, layout.RECEIPT)
    assert all((fast[2][k] == slow[2][k]).all() if isinstance(fast[2][k], np.ndarray) else fast[2][k].equals(slow[2][k]) for k in fast[2])


@pytest.mark.parametrize("rows", [1, 800])
def test_lines_of_40000_boxes(rows):
    f = sheet(40_000, rows, random.Random(2))
    zeros = np.zeros(40_000, np.int64)
    began = time.process_time()
    _, _, found = pagewise.lines(zeros, zeros > 0, f, layout.RECEIPT)
    assert len(found["line"]) == rows and time.process_time() - began < 10


BOXES = "page_id long, id long, x double, y double, width double, height double"


def test_touching_boxes(spark):
    r = random.Random(9)
    side = lambda: r.choice([0, 1, 5, 16, 31, 32, 33, 64, 100, 700])
    rows = [(r.randint(0, 2), k, float(r.randint(-200, 400)), float(r.randint(-200, 400)), float(side()), float(side())) for k in range(250)]
    odd = [(0, 900, None, 0.0, 1.0, 1.0), (0, 901, float("nan"), 0.0, 1.0, 1.0), (0, 902, 0.0, 0.0, -5.0, 1.0), (None, 903, 0.0, 0.0, 5.0, 5.0)]
    a, b = spark.createDataFrame(rows[:150] + odd, BOXES), spark.createDataFrame(rows[100:] + odd, BOXES)
    meets = lambda p, q: p[0] == q[0] and p[2] <= q[2] + q[4] and q[2] <= p[2] + p[4] and p[3] <= q[3] + q[5] and q[3] <= p[3] + p[5]
    want = sorted((p[0], p[1], q[1]) for p in rows[:150] for q in rows[100:] if meets(p, q))
    for unit in (1.0, 32.0, 1000.0):
        found = boxes.touching(a, b, unit=unit)
        assert sorted((x.page_id, x.a.id, x.b.id) for x in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert boxes.touching(a.limit(0), b).count() == 0
