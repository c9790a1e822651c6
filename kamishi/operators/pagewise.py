"""Kernels over batches of whole pages: sweeps, components and cuts on flat numpy arrays.

A page comes as one row with an array of its boxes, so a page's boxes must fit a task. All pages of a
batch are worked on together: every step is an operation on arrays in which a page is a run of rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a kernel takes at a time (whole pages, at least one).
SLICE_ROWS = 200_000


def map_pages(df: DataFrame, columns: list[str], kernel: Callable, schema: str, orientation=None) -> DataFrame:
    """page_id and the columns of schema: kernel's answer to the rows of all pages.

    kernel(page, vertical, fields) gets row arrays (page number, orientation, a dict of the columns)
    and returns (page number, dict) of rows to emit. One exchange, by page_id.
    """
    turned = F.first("orientation") if orientation is None else orientation
    pages = df.groupBy("page_id").agg(turned.alias("orientation"), F.collect_list(F.struct(*columns)).alias("rows"))
    out = T.StructType([T.StructField("page_id", df.schema["page_id"].dataType), *T._parse_datatype_string(schema).fields])

    def run(batches):
        for batch in batches:
            lens = pc.list_value_length(batch.column("rows")).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(lens) // SLICE_ROWS
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(lens) else []
            for lo, hi in zip(cut, [*cut[1:], len(lens)], strict=False):
                held = batch.slice(lo, hi - lo)
                page = np.repeat(np.arange(hi - lo), lens[lo:hi])
                fields = dict(zip(columns, held.column("rows").flatten().flatten(), strict=True))
                fields = {k: v if pa.types.is_string(v.type) or pa.types.is_large_string(v.type) else v.to_numpy(zero_copy_only=False) for k, v in fields.items()}
                vertical = pc.equal(held.column("orientation"), "vertical").to_numpy(zero_copy_only=False)[page]
                at, answer = kernel(page, vertical, fields)
                named = [v if isinstance(v, pa.Array) else pa.array(v) for v in answer.values()]
                yield pa.RecordBatch.from_arrays([held.column("page_id").take(pa.array(at)), *named], ["page_id", *answer])

    return pages.mapInArrow(run, out)


def along(vertical, f):
    """Bounds along (rs, re) and across (cs, ce) the reading direction."""
    right, bottom = f["x"] + f["width"], f["y"] + f["height"]
    pick = lambda a, b: np.where(vertical, b, a)
    return pick(f["x"], f["y"]), pick(right, bottom), pick(f["y"], f["x"]), pick(bottom, right)


def overlap_ratio(lo_a, hi_a, lo_b, hi_b):
    side = np.minimum(hi_a - lo_a, hi_b - lo_b)
    shared = np.maximum(0.0, np.minimum(hi_a, hi_b) - np.maximum(lo_a, lo_b))
    return np.where(side > 0, shared / np.where(side > 0, side, 1.0), 0.0)


def gap(lo_a, hi_a, lo_b, hi_b):
    return np.maximum(0.0, np.maximum(lo_a, lo_b) - np.minimum(hi_a, hi_b))


def sweep(page, step):
    """Pairs (a, b) of rows of one page for which step says so; b runs on from a as long as step lets it.

    step(a, b) gives (whether to pair, whether to go on) for arrays of pairs; all rows advance together.
    """
    first, second = [], []
    a, d = np.arange(len(page)), 1
    while len(a):
        a = a[a + d < len(page)]
        a = a[page[a + d] == page[a]]
        near, on = step(a, a + d)
        first.append(a[near])
        second.append(a[near] + d)
        a, d = a[on], d + 1
    return (np.concatenate(first), np.concatenate(second)) if first else (np.empty(0, np.int64), np.empty(0, np.int64))


def components(n, a, b):
    """The least row that each of n rows reaches over the pairs."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label[label] == label).all():
            label = label[label]


def runs(values):
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


def within(values):
    """The place of each row in its run of equal values."""
    opens = runs(values)
    return np.arange(len(values)) - np.repeat(opens, np.diff(np.append(opens, len(values))))


def boxes_of(f, order, opens):
    """Boxes around runs of rows."""
    x, y = np.minimum.reduceat(f["x"][order], opens), np.minimum.reduceat(f["y"][order], opens)
    right, bottom = np.maximum.reduceat((f["x"] + f["width"])[order], opens), np.maximum.reduceat((f["y"] + f["height"])[order], opens)
    return {"x": x, "y": y, "width": right - x, "height": bottom - y}


#: Pages of more boxes than this are swept one by one where a line may have any gap.
LONE_PAGE = 64


def aligned_components(lo, hi, ratio):
    """Components of intervals linked where they overlap by ratio (above 0, 1 at most) of the shorter.

    In order of lo, an earlier a is linked to b if b begins before a's last ratio does, or if a ends
    after b's first ratio. Intervals of the first kind overlap each other that much already, so the one
    that reaches furthest stands for them; of the second kind every component counts whose furthest end
    lies there. Components leave once b begins after their end: n log n steps in all.
    """
    order = np.lexsort((hi, lo))
    parent = list(range(len(lo)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    far, far_at = -np.inf, -1
    live = []  # (furthest end, whose) of each component, in that order
    ends = {}  # root: its entry
    for i, a, b in zip(order.tolist(), lo[order].tolist(), hi[order].tolist(), strict=True):
        size = b - a
        if size <= 0:
            continue
        while live and live[0][0] <= a:
            ends.pop(root(live.pop(0)[1]), None)
        own, end = i, (b, i)
        slack = 1e-9 * (abs(a) + size)
        while live and live[-1][0] >= a + ratio * size - slack:
            e, j = live[-1]
            if min(e, b) - a < ratio * size and (min(e, b) - a) / min(size, e - lo[j]) < ratio:
                break
            live.pop()
            r = root(j)
            ends.pop(r, None)
            parent[max(own, r)] = own = min(own, r)
            end = max(end, (e, j))
        if far >= a - slack and far_at >= 0 and root(far_at) != own and (min(hi[far_at], b) - a) / min(size, hi[far_at] - lo[far_at]) >= ratio:
            r = root(far_at)
            held = ends.pop(r, None)
            if held is not None:
                del live[bisect_left(live, held)]
                end = max(end, held)
            parent[max(own, r)] = own = min(own, r)
        insort(live, end)
        ends[own] = end
        if b - ratio * size > far:
            far, far_at = b - ratio * size, i
    return np.array([root(i) for i in range(len(lo))], np.int64)


def lines(page, vertical, f, options):
    """(page, vertical, fields) of the lines, in order of page and label: the least rank of a member by
    reading start. Members of a line stand by reading start, ties by obs_id."""
    rs, re, cs, ce = along(vertical, f)
    order = np.lexsort((f["obs_id"], rs, page))
    page, vertical, rs, re, cs, ce = (v[order] for v in (page, vertical, rs, re, cs, ce))

    def step(a, b):
        near, on = overlap_ratio(cs[a], ce[a], cs[b], ce[b]) >= options.line_overlap, np.ones(len(a), bool)
        if options.line_gap_factor is not None:
            reach = options.line_gap_factor * np.maximum(ce[a] - cs[a], ce[b] - cs[b])
            near &= gap(rs[a], re[a], rs[b], re[b]) <= reach
            if options.early_exit:
                on = rs[b] <= re[a] + reach
        return near, on

    starts = runs(page)
    label = np.arange(len(page))
    small = np.ones(len(page), bool)
    if options.line_gap_factor is None and 0 < options.line_overlap <= 1:
        for lo, n in zip(starts.tolist(), np.diff(np.append(starts, len(page))).tolist(), strict=True):
            if n > LONE_PAGE:
                small[lo : lo + n] = False
                label[lo : lo + n] = lo + aligned_components(cs[lo : lo + n], ce[lo : lo + n], options.line_overlap)
    rows = np.flatnonzero(small)
    label[rows] = rows[components(len(rows), *sweep(page[rows], lambda a, b: step(rows[a], rows[b])))]
    members = np.argsort(label, kind="stable")
    opens = runs(label[members])
    if not len(opens):
        return page, vertical, {k: np.empty(0) for k in ("x", "y", "width", "height", "confidence")} | {"line": np.empty(0, np.int64), "text": pa.array([], pa.string()), "spaced_text": pa.array([], pa.string()), "n_obs": np.empty(0, np.int64), "first_obs": np.empty(0, np.int32)}
    count = np.diff(np.append(opens, len(label)))
    texts = pa.ListArray.from_arrays(pa.array(np.append(opens, len(label)).astype(np.int32)), pc.fill_null(f["text"], "").cast(pa.string()).take(pa.array(order[members])))
    head = members[opens]
    start = np.repeat(starts, np.diff(np.append(starts, len(page))))
    out = {
        "line": label[head] - start[head], "text": pc.binary_join(texts, ""), "spaced_text": pc.binary_join(texts, " "), **boxes_of(f, order[members], opens),
        "confidence": np.add.reduceat(f["confidence"][order[members]], opens) / count, "n_obs": count, "first_obs": np.minimum.reduceat(f["obs_id"][order[members]], opens),
    }
    return page[head], vertical[head], out


def blocks(page, vertical, f, options):
    """(block, in_block) of lines: the least rank by first_obs of a line of the block, and the place in
    it, downwards or, if vertical, leftwards."""
    n = len(page)
    rs, re, cs, ce = along(vertical, f)
    by_size = np.lexsort((ce - cs, page))
    opens = runs(page)
    count = np.diff(np.append(opens, n))
    size = (ce - cs)[by_size]
    median = (size[opens + (count - 1) // 2] + size[opens + count // 2]) / 2 if n else np.empty(0)
    limit = options.block_gap_factor * np.repeat(median, count)
    numbered = np.lexsort((f["first_obs"], page))
    pos = np.empty(n, np.int64)
    pos[numbered] = np.arange(n)
    order = np.lexsort((pos, cs, page))
    q, s, e, lo, hi, far = page[order], rs[order], re[order], cs[order], ce[order], limit[order]

    def step(a, b):
        on = lo[b] - hi[a] <= far[a]  # rows stand by their upper bound, so none further on is nearer
        return (overlap_ratio(s[a], e[a], s[b], e[b]) >= options.block_overlap) & (gap(lo[a], hi[a], lo[b], hi[b]) <= far[a]), on

    a, b = sweep(q, step)
    label = components(n, pos[order[a]], pos[order[b]])[pos]
    across = np.where(vertical, -(f["x"] + f["width"] / 2), f["y"] + f["height"] / 2)
    placed = np.lexsort((pos, across, label))
    in_block = np.empty(n, np.int64)
    in_block[placed] = within(label[placed])
    return label - np.repeat(opens, count), in_block


def _parts(segment, lo, hi, min_gap):
    """The island of each row on an axis: rows of a segment are cut where a gap reaches min_gap of its extent."""
    order = np.lexsort((hi, lo, segment))
    g, a, b = segment[order], lo[order], hi[order]
    opens = runs(g)
    number = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(g))))
    value, rank = np.unique(b, return_inverse=True)
    until = value[np.maximum.accumulate(rank + number * len(value)) - number * len(value)]  # greatest end so far
    need = min_gap * (np.maximum.reduceat(b, opens) - a[opens])
    cut = np.zeros(len(g), bool)
    cut[1:] = (number[1:] == number[:-1]) & (a[1:] > until[:-1]) & (a[1:] - until[:-1] >= need[number[1:]])
    total = np.cumsum(cut)
    part = np.empty(len(g), np.int64)
    part[order] = total - total[opens][number]
    return part


def reading_ranks(page, vertical, f, min_gap=0.005):
    """The rank of each box on its page: cut at projection gaps, columns first (or, if vertical, sections
    first and then columns from the right), until none is left; then downwards, ties in reading direction."""
    segment = np.unique(page, return_inverse=True)[1] if len(page) else page
    spans = (f["x"], f["x"] + f["width"]), (f["y"], f["y"] + f["height"])
    live = np.bincount(segment)[segment] > 1 if len(page) else np.empty(0, bool)
    while live.any():
        rows = np.flatnonzero(live)
        part, split = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        own = np.unique(segment[rows], return_inverse=True)[1]
        for turn in (0, 1):  # horizontal pages are cut along x, then y; vertical ones along y, then x
            axis = np.where(vertical[rows], 1 - turn, turn)
            todo = np.flatnonzero(~split)
            if not len(todo):
                break
            lo, hi = (np.where(axis[todo] == 0, spans[0][k][rows[todo]], spans[1][k][rows[todo]]) for k in (0, 1))
            got = _parts(own[todo], lo, hi, min_gap)
            many = np.zeros(own.max() + 1, np.int64)
            np.maximum.at(many, own[todo], got)
            part[todo] = np.where((axis[todo] == 0) & vertical[rows[todo]], many[own[todo]] - got, got)
            split[todo] = many[own[todo]] > 0
        whole = np.zeros(len(segment), np.int64)
        whole[rows] = np.where(split, part, 0)
        segment = np.unique(segment * (len(segment) + 1) + whole, return_inverse=True)[1]
        live[rows] = split
        live &= np.bincount(segment)[segment] > 1
    middle_x = (f["x"] + f["width"] / 2) * np.where(vertical, -1, 1)
    order = np.lexsort((np.arange(len(page)), middle_x, f["y"] + f["height"] / 2, segment))
    order = order[np.argsort(page[order], kind="stable")]
    rank = np.empty(len(page), np.int64)
    rank[order] = within(page[order])
    return rank


def table_bands(page, lo, hi, tie, ratio):
    """(page, lo, hi) of the bands of each page's intervals, in that order.

    From the narrowest interval to the widest: one that no band hits opens a band, one that one band hits
    widens it, and one that more hit is a spanning cell and changes nothing. A band hits where the overlap
    is ratio of the shorter at least. Bands stand sorted by lo; none is longer than the longest so far, so
    bisection finds all that can reach an interval.
    """
    order = np.lexsort((tie, hi, lo, hi - lo, page))
    opens = runs(page[order])
    out = []
    for at, end in zip(opens.tolist(), [*opens[1:].tolist(), len(page)], strict=False):
        rows = order[at:end]
        los, his, longest = [], [], 0.0
        for a, b in zip(lo[rows].tolist(), hi[rows].tolist(), strict=True):
            size = b - a
            first = bisect_left(los, a - longest - 1e-9 * (abs(a) + longest)) if ratio > 0 else 0
            last = bisect_left(los, b) if ratio > 0 else len(los)
            hits = []
            for k in range(first, last):
                side = min(his[k] - los[k], size)
                if side > 0 and max(0.0, min(his[k], b) - max(los[k], a)) >= ratio * side:
                    hits.append(k)
                    if len(hits) > 1:
                        break
            if len(hits) == 1:
                a, b = min(a, los[hits[0]]), max(b, his[hits[0]])
                del los[hits[0]], his[hits[0]]
            if len(hits) < 2:
                k = bisect_left(los, a)
                los.insert(k, a)
                his.insert(k, b)
                longest = max(longest, b - a)
        out.append((np.full(len(los), page[rows[0]]), los, his))
    if not out:
        return page[:0], lo[:0], hi[:0]
    p, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((b, a, p))
    return p[order], a[order], b[order]


def interval_bands(page, lo, hi, tie, ratio):
    """(order, band) of intervals: rows by page, lo, hi, tie, and the number of each one's band on its page.

    Rows come by lo, so a band or member that ended before has no part in any later row: only those still
    open are compared, the newest band first.
    """
    order = np.lexsort((tie, hi, lo, page))
    band = np.empty(len(order), np.int64)
    n, last, live = 0, None, []  # live: [number, end, open members (lo, hi)] of bands, oldest first
    for i, p, a, b in zip(range(len(order)), page[order].tolist(), lo[order].tolist(), hi[order].tolist(), strict=True):
        if p != last:
            n, last, live = 0, p, []
        live = [x for x in live if x[1] > a]
        for own in reversed(live) if b > a or ratio <= 0 else ():
            own[2] = [m for m in own[2] if m[1] > a or ratio <= 0]
            if min(own[1], b) - max(own[3], a) > 0 and any(_ratio(m, a, b) >= ratio for m in own[2]):
                own[1] = max(own[1], b)
                own[2].append((a, b))
                band[i] = own[0]
                break
        else:
            band[i] = n
            live.append([n, b, [(a, b)], a])
            n += 1
    return order, band


def _ratio(m, a, b):
    side = min(m[1] - m[0], b - a)
    return max(0.0, min(m[1], b) - max(m[0], a)) / side if side > 0 else 0.0


def _keys(pages, *values):
    """Numbers that order pairs of page and value alike for all of some arrays of values."""
    _, rank = np.unique(np.concatenate(values), return_inverse=True)
    top, at = len(rank) + 1, np.cumsum([0, *map(len, values)])
    return [p * top + rank[i:j] for p, i, j in zip(pages, at, at[1:], strict=False)]


def _spread(begin, n):
    """begin, begin + 1, ... for n of each, and whose each is."""
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) + np.repeat(begin - np.cumsum(n) + n, n), owner


#: Pairs of an interval and a band that are compared at a time.
PAIRS = 1 << 21


def assign_bands(page, lo, hi, bands, ratio):
    """(first, span) of the bands that each interval hits, numbered within its page; without a hit the band
    nearest by centre, the first of equals. Bands as table_bands gives them; an interval join by bisection."""
    b_page, b_lo, b_hi = bands
    base, end = np.searchsorted(b_page, page), np.searchsorted(b_page, page, "right")
    longest = np.zeros(int(page.max()) + 1 if len(page) else 0)
    np.maximum.at(longest, b_page, b_hi - b_lo)
    if ratio > 0:
        reach = longest[page]
        own, begin, stop = _keys((b_page, page, page), b_lo, lo - reach - 1e-9 * (np.abs(lo) + reach), hi)
        begin, stop = np.searchsorted(own, begin), np.searchsorted(own, stop)
        begin, stop = np.clip(begin, base, end), np.clip(stop, base, end)
        stop = np.maximum(begin, stop)
    else:
        begin, stop = base, end
    first, last = np.full(len(page), -1), np.full(len(page), -1)
    part = np.cumsum(stop - begin) // PAIRS
    cut = runs(part)
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(page)], strict=False):
        k, owner = _spread(begin[i:j], (stop - begin)[i:j])
        a, b = lo[i:j][owner], hi[i:j][owner]
        side = np.minimum(b_hi[k] - b_lo[k], b - a)
        hit = (side > 0) & (np.maximum(0.0, np.minimum(b_hi[k], b) - np.maximum(b_lo[k], a)) >= ratio * side)
        k, owner = k[hit], owner[hit]
        first[i + owner[::-1]] = k[::-1]  # the last write stays
        last[i + owner] = k
    lone = np.flatnonzero(first < 0)
    if len(lone):
        middle = (b_lo + b_hi) / 2
        order = np.lexsort((np.arange(len(middle)), middle, b_page))
        own, wanted = _keys((b_page[order], page[lone]), middle[order], (lo[lone] + hi[lone]) / 2)
        right = np.searchsorted(own, wanted)
        left = np.searchsorted(own, own[np.maximum(right - 1, 0)])
        has_left, has_right = right > base[lone], right < end[lone]
        c = (lo[lone] + hi[lone]) / 2
        pick_l, pick_r = order[np.minimum(left, len(order) - 1)], order[np.minimum(right, len(order) - 1)]
        d_l, d_r = np.where(has_left, np.abs(middle[pick_l] - c), np.inf), np.where(has_right, np.abs(middle[pick_r] - c), np.inf)
        first[lone] = last[lone] = np.where((d_l < d_r) | (d_l == d_r) & (pick_l < pick_r), pick_l, pick_r)
    return first - base, last - first + 1


def table_cells(page, f, ratio, options):
    """((page, fields) of the cells, (page, row count, column count) of the tables) of whole pages."""
    page, _, found = lines(page, np.zeros(len(page), bool), f, options)
    spans = {"y": (found["y"], found["y"] + found["height"]), "x": (found["x"], found["x"] + found["width"])}
    bands = {at: table_bands(page, lo, hi, found["first_obs"], ratio) for at, (lo, hi) in spans.items()}
    row, row_span = assign_bands(page, *spans["y"], bands["y"], ratio)
    col, col_span = assign_bands(page, *spans["x"], bands["x"], ratio)
    order = np.lexsort((found["first_obs"], found["x"], found["y"], col, row, page))
    number = np.stack((page, row, col))[:, order]
    opens = np.flatnonzero(np.append(True, (number[:, 1:] != number[:, :-1]).any(axis=0))) if len(page) else np.empty(0, np.int64)
    pages = page[runs(page)]
    sizes = [np.searchsorted(bands[at][0], pages, "right") - np.searchsorted(bands[at][0], pages) for at in "yx"]
    if not len(opens):
        return page, {"row": row, "col": col, "row_span": row, "col_span": col, "text": found["text"], **{c: np.empty(0) for c in ("x", "y", "width", "height")}}, (pages, *sizes)
    texts = pa.ListArray.from_arrays(pa.array(np.append(opens, len(order)).astype(np.int32)), found["text"].take(pa.array(order)))
    spans = {k: np.maximum.reduceat(v[order], opens) for k, v in (("row_span", row_span), ("col_span", col_span))}
    cells = {"row": number[1][opens], "col": number[2][opens], **spans, "text": pc.binary_join(texts, ""), **boxes_of(found, order, opens)}
    return number[0][opens], cells, (pages, *sizes)
