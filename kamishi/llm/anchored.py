"""Repeated windows across a corpus, found by content-routed shards.

A window is `window` consecutive units (bytes or words) of one text. Its anchor is its least gram, so
equal windows meet at equal anchors. Documents are dealt into work groups by their id, anchors into
shards by their gram, and each shard sees one entry for a context and work group, however often the
context occurs there: a hot passage costs a shard no more entries than there are work groups.

  summarize  work group -> shards   contexts (anchor with all windows that it stands for), combined
  resolve    shard -> work groups   what equal contexts have elsewhere; which contexts to compare
  fetch      work group -> shards   units of those contexts, one copy of each
  compare    shard -> work groups   windows shared between different contexts (suffix array, FM-index)
  apply      work group             units covered, document by document

A gram with more than `hot` contexts is not compared in one shard: its windows are dealt out by their
own hashes and combined like contexts. All steps are DataFrame group-maps; Spark shuffles between
them, and the shuffled texts are read again by each step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesvec as bv
from .common import text_bytes, unused

GROUP_BYTES, SHARD_BYTES, CHUNK_BYTES, COMPARE_BYTES = 2 << 20, 16 << 20, 120_000, 1 << 20
#: Text that a task reads; where the session's shuffle partitions would give it more, there are more of them.
TASK_BYTES = 32 << 20
NULL_ID = np.int64(2**63 - 1)
SMALLER, ELSEWHERE = "smaller", "elsewhere"


@dataclass(frozen=True)
class Spec:
    """rule SMALLER: a window counts as repeated if it also starts in a document with a smaller id;
    ELSEWHERE: if it also starts anywhere else. compare gets the contexts of one shard."""

    window: int
    gram: int
    words: bool
    rule: str
    compare: Callable[[Spec, Contexts], tuple]
    hot: int = 4096


@dataclass
class Contexts:
    """Different contexts of one shard: units of context x are units[at[x]:at[x+1]], its anchor is at
    left[x] in them, val[x] its least document id (SMALLER) or number of occurrences (ELSEWHERE)."""

    key: np.ndarray
    val: np.ndarray
    left: np.ndarray
    at: np.ndarray
    units: np.ndarray


@dataclass
class Chunk:
    """Anchors of some consecutive texts of a work group."""

    lo: int
    buf: np.ndarray
    offs: np.ndarray  # of units
    units: np.ndarray
    spans: tuple | None  # word starts and ends
    grams: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    ctx: np.ndarray
    doc: np.ndarray  # row in the work group

    def window_hashes(self, spec, which):
        """(owner, start, hash, second hash) of the windows of the anchors `which`; a window with
        several anchors belongs to its first."""
        order = np.lexsort((self.anchor, self.key))
        same = self.key[order][1:] == self.key[order][:-1]
        begin = self.first.copy()
        begin[order[1:][same]] = np.maximum(begin[order[1:][same]], self.anchor[order[:-1][same]] + 1)
        n = np.maximum(self.last[which] - begin[which] + 1, 0)
        owner = np.repeat(which, n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner]
        end = start + spec.window - spec.gram + 1
        two = [bv.mix(bv.span_hash(bv.prefix_sums(g), start, end)) for g in (self.grams, bv.mix(self.grams))]
        return owner, start, *two


def chunks(texts, spec):
    buf, offs = bv.buffer_of(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
        part, cut = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        spans = None
        units, uoffs = part, cut
        if spec.words:
            starts, ends, uoffs = bv.word_spans(part, cut)
            spans, units = (starts, ends), bv.word_hashes(part, starts, ends)
        grams = bv.gram_hashes(units, uoffs, spec.gram)
        anchor, first, last = bv.minimizers(grams, uoffs, spec.window, spec.gram)
        raw = bv.span_hash(bv.prefix_sums(grams), first, last + spec.window - spec.gram + 1)
        shape = ((anchor - first) * 1_000_003 + (last - first)).astype(np.uint64)
        doc = lo + np.searchsorted(uoffs, anchor, "right") - 1
        yield Chunk(lo, part, uoffs, units, spans, grams, anchor, first, last, grams[anchor], bv.mix(raw ^ bv.mix(shape)), doc)
        lo = hi


def combine(spec, key, ctx, val):
    """Unique (key, ctx) with the least or summed val; sorted."""
    if not len(key):
        return key, ctx, val
    order = np.lexsort((ctx, key))
    key, ctx, val = key[order], ctx[order], val[order]
    at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]))))
    return key[at], ctx[at], (np.minimum if spec.rule == SMALLER else np.add).reduceat(val, at)


def find(key, ctx, in_key, in_ctx):
    """Index of each (key, ctx) in the sorted (in_key, in_ctx), -1 where absent."""
    if not len(in_key) or not len(key):
        return np.full(len(key), -1)
    table, order = bv.mix(in_key ^ bv.mix(in_ctx)), None
    order = np.argsort(table)
    asked = bv.mix(key ^ bv.mix(ctx))
    at = np.minimum(np.searchsorted(table, asked, sorter=order), len(table) - 1)
    at = order[at]
    return np.where((in_key[at] == key) & (in_ctx[at] == ctx), at, -1)


def pack(*arrays) -> bytes:
    return b"".join(np.ascontiguousarray(a).view(np.int64).tobytes() for a in arrays)


def unpack(payload, n_arrays):
    """Arrays of all payloads (each holds n_arrays of equal length), and which payload each is from."""
    parts = [np.frombuffer(p, np.int64).reshape(n_arrays, -1) for p in payload]
    if not parts:
        return np.empty((n_arrays, 0), np.int64), np.empty(0, np.int64)
    return np.concatenate(parts, axis=1), np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])


def _rows(schema, rows):
    return pa.Table.from_pylist(rows, schema=schema) if rows else schema.empty_table()


def _deal(to, *arrays):
    """(target, packed arrays) by target."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    for lo, hi in zip(cut, [*cut[1:], len(to)], strict=True):
        yield int(to[lo]), pack(*(a[order[lo:hi]] for a in arrays))


def ids_of(table):
    return table.column("doc_id").cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy()


SUMMARY = pa.schema([("shard", pa.int64()), ("_b", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
REPLY = pa.schema([("_b", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
SUMMARY_DDL, REPLY_DDL = "shard long, _b long, kind int, payload binary", "_b long, kind int, payload binary"
CLASS, RANGE, WINDOWS = 0, 1, 2  # kinds of replies
COMPARE, FROM_HOT = 1, 2  # flags of classes
U = np.uint64


def summaries(spec, table, scanned):
    """This work group's contexts, combined."""
    ids = ids_of(table)
    parts = [(c.key, c.ctx, ids[c.doc] if spec.rule == SMALLER else np.ones(len(c.key), np.int64)) for c in scanned]
    return combine(spec, *(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.empty(0, U), np.empty(0, U), np.empty(0, np.int64))


def summarize(spec, n_shards, group):
    def run(table):
        bv.release()
        b = table.column(group)[0].as_py()
        key, ctx, val = summaries(spec, table, chunks(table.column("text"), spec))
        return _rows(SUMMARY, [{"shard": s, "_b": b, "kind": 0, "payload": p} for s, p in _deal((key % U(n_shards)).astype(np.int64), key, ctx, val)])

    return run


def resolve(spec):
    def run(table):
        bv.release()
        (key, ctx, val), src = unpack(table.column("payload").to_pylist(), 3)
        key, ctx, b = key.view(U), ctx.view(U), table.column("_b").to_numpy()[src]
        if not len(key):
            return REPLY.empty_table()
        order = np.lexsort((val, ctx, key))
        key, ctx, val, b = key[order], ctx[order], val[order], b[order]
        opens_key = np.concatenate(([True], key[1:] != key[:-1]))
        opens = opens_key | np.concatenate(([True], ctx[1:] != ctx[:-1]))
        cls = np.cumsum(opens) - 1
        at = np.flatnonzero(opens)
        total = (np.minimum if spec.rule == SMALLER else np.add).reduceat(val, at)
        kid = (np.cumsum(opens_key) - 1)[at]
        n_classes = np.bincount(kid)
        if spec.rule == SMALLER:  # a class that is not the gram's least may have windows of a smaller one
            least = np.full(len(n_classes), NULL_ID)
            np.minimum.at(least, kid, total)
            asks = (total > least[kid]).astype(np.int64)
            told = val > total[cls]
        else:
            asks = (total == 1).astype(np.int64)
            told = (total[cls] >= 2) & (val == 1)
        compared = (n_classes[kid] > 1) & (np.bincount(kid, weights=asks)[kid] > 0)
        flag = np.where(compared, np.where(n_classes[kid] > spec.hot, FROM_HOT, COMPARE), 0)
        member_flag = np.where(opens, flag[cls], 0)  # only the first member, the least by val, delivers the units
        use = told | (member_flag > 0)
        return _rows(REPLY, [{"_b": t, "kind": CLASS, "payload": p} for t, p in _deal(b[use], key[use], ctx[use], total[cls][use], member_flag[use])])

    return run


def _replies(table, kind, n):
    rows = [p for k, p in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True) if k == kind]
    return unpack(rows, n)[0]


def fetch(spec, n_shards, group):
    def run(left, right):
        bv.release()
        key, ctx, val, flag = _replies(right, CLASS, 4)
        key, ctx = key.view(U), ctx.view(U)
        asked = flag > 0
        if not asked.any() or not left.num_rows:
            return SUMMARY.empty_table()
        key, ctx, val, flag = key[asked], ctx[asked], val[asked], flag[asked]
        b = left.column(group)[0].as_py()
        seen = np.zeros(len(key), bool)
        got, hot = [], []
        for c in chunks(left.column("text"), spec):
            hit = find(c.key, c.ctx, key, ctx)
            own, where = np.unique(hit, return_index=True)
            ok = (own >= 0) & ~seen[own]
            own, where = own[ok], where[ok]
            seen[own] = True
            for o, a in zip(own[flag[own] == COMPARE], where[flag[own] == COMPARE], strict=True):
                got.append((o, c.anchor[a] - c.first[a], c.units[c.first[a] : c.last[a] + spec.window]))
            of = where[flag[own] == FROM_HOT]
            if len(of):
                owner, _, h, h2 = c.window_hashes(spec, of)
                back = np.zeros(len(c.key), np.int64)
                back[where] = own
                hot.append(combine(spec, h, h2, val[back[owner]]))
        rows = []
        shard = (key % U(n_shards)).astype(np.int64)
        by: dict[int, list] = {}
        for g in got:
            by.setdefault(int(shard[g[0]]), []).append(g)
        for s, gs in by.items():
            o = np.array([g[0] for g in gs])
            lens = np.array([len(g[2]) for g in gs])
            head = np.array([[len(gs)]], np.int64)
            meta = pack(head, key[o], ctx[o], val[o], np.array([g[1] for g in gs], np.int64), lens.astype(np.int64))
            rows.append({"shard": s, "_b": b, "kind": 0, "payload": meta + np.concatenate([g[2] for g in gs]).tobytes()})
        if hot:
            h, h2, v = combine(spec, *(np.concatenate(x) for x in zip(*hot, strict=True)))
            rows += [{"shard": s, "_b": b, "kind": 1, "payload": p} for s, p in _deal((h % U(n_shards)).astype(np.int64), h, h2, v)]
        return _rows(SUMMARY, rows)

    return run


def slices(key, size):
    """Consecutive ranges of about COMPARE_BYTES that no key crosses."""
    part = (np.cumsum(size) - size) // COMPARE_BYTES
    opens = np.concatenate(([True], key[1:] != key[:-1]))
    part = part[np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    return zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True)


def compare(spec):
    def run(table):
        bv.release()
        kinds, payload, b = table.column("kind").to_pylist(), table.column("payload").to_pylist(), table.column("_b").to_pylist()
        rows, metas, units, owner = [], [], [], []
        for k, p, w in zip(kinds, payload, b, strict=True):
            if k == 0:
                n = int(np.frombuffer(p, np.int64, 1)[0])
                metas.append(np.frombuffer(p, np.int64, 5 * n, 8).reshape(5, n))
                units.append(np.frombuffer(p, U if spec.words else np.uint8, -1, 8 + 40 * n))
                owner.append(np.full(n, w))
        if metas:
            key, ctx, val, left, lens = np.concatenate(metas, axis=1)
            owner, units = np.concatenate(owner), np.concatenate(units)
            begin = np.cumsum(lens) - lens
            order = np.argsort(key.view(U), kind="stable")
            for lo, hi in slices(key[order], lens[order] * units.itemsize):  # whole grams, so that each slice is complete
                o = order[lo:hi]
                at = np.concatenate(([0], np.cumsum(lens[o])))
                pick = np.arange(at[-1]) + np.repeat(begin[o] - at[:-1], lens[o])
                who, start, end = spec.compare(spec, Contexts(key[o].view(U), val[o], left[o], at, units[pick]))
                rows += [{"_b": t, "kind": RANGE, "payload": x} for t, x in _deal(owner[o][who], key[o][who], ctx[o][who], start, end)]
        hot = [(p, w) for k, p, w in zip(kinds, payload, b, strict=True) if k == 1]
        if hot:
            (h, h2, val), src = unpack([p for p, _ in hot], 3)
            h, h2, who = h.view(U), h2.view(U), np.array([w for _, w in hot])[src]
            ah, ah2, total = combine(spec, h, h2, val)
            total = total[find(h, h2, ah, ah2)]
            told = total < val if spec.rule == SMALLER else total > val
            rows += [{"_b": t, "kind": WINDOWS, "payload": x} for t, x in _deal(who[told], h[told], h2[told], total[told])]
        return _rows(REPLY, rows)

    return run


def hot_windows(spec, scanned, key, ctx, val, hot):
    """Windows of the hot contexts that this work group delivered, combined."""
    seen = np.zeros(len(key), bool)
    out = []
    for c in scanned:
        own, where = np.unique(find(c.key, c.ctx, key, ctx), return_index=True)
        ok = hot[own] & ~seen[own]
        seen[own[ok]] = True
        if ok.any():
            back = np.zeros(len(c.key), np.int64)
            back[where] = own
            owner, _, h, h2 = c.window_hashes(spec, where[ok])
            out.append((h, h2, val[back[owner]]))
    return combine(spec, *(np.concatenate(x) for x in zip(*out, strict=True))) if out else (np.empty(0, U), np.empty(0, U), np.empty(0, np.int64))


def covered(spec, table, replies):
    """Per chunk of the work group: (chunk, mask of covered units)."""
    ids = ids_of(table)
    scanned = list(chunks(table.column("text"), spec))
    key, ctx, val = summaries(spec, table, scanned)
    rkey, rctx, rval, rflag = _replies(replies, CLASS, 4)
    at = find(rkey.view(U), rctx.view(U), key, ctx)
    hot = np.zeros(len(val), bool)
    val[at], hot[at] = rval, rflag == FROM_HOT
    ikey, ictx, istart, iend = _replies(replies, RANGE, 4)
    by = np.lexsort((ictx.view(U), ikey.view(U)))
    ikey, ictx, istart, iend = ikey[by].view(U), ictx[by].view(U), istart[by], iend[by]
    opens = np.flatnonzero(np.concatenate(([True], (ikey[1:] != ikey[:-1]) | (ictx[1:] != ictx[:-1])))) if len(ikey) else np.empty(0, np.int64)
    until = np.append(opens[1:], len(ikey))
    wh, wh2, wval = hot_windows(spec, scanned, key, ctx, val, hot) if hot.any() else (np.empty(0, U), np.empty(0, U), np.empty(0, np.int64))
    if len(wh):
        h, h2, total = _replies(replies, WINDOWS, 3)
        wval[find(h.view(U), h2.view(U), wh, wh2)] = total
    for c in scanned:
        cls = find(c.key, c.ctx, key, ctx)
        full = ids[c.doc] > val[cls] if spec.rule == SMALLER else val[cls] >= 2
        edges = np.zeros(len(c.units) + 1, np.int64)
        np.add.at(edges, c.first[full], 1)
        np.add.at(edges, c.last[full] + spec.window, -1)
        rest = np.flatnonzero(~full)
        if len(ikey):
            hit = find(c.key[rest], c.ctx[rest], ikey[opens], ictx[opens])
            a, hit = rest[hit >= 0], hit[hit >= 0]
            n = until[hit] - opens[hit]
            pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(opens[hit], n)
            base = np.repeat(c.anchor[a], n)
            np.add.at(edges, base + istart[pick], 1)
            np.add.at(edges, base + iend[pick], -1)
        of = rest[hot[cls[rest]]]
        if len(of):
            owner, start, h, h2 = c.window_hashes(spec, of)
            at = find(h, h2, wh, wh2)
            yes = wval[at] < val[cls[owner]] if spec.rule == SMALLER else wval[at] >= 2
            np.add.at(edges, start[yes], 1)
            np.add.at(edges, start[yes] + spec.window, -1)
        yield c, np.cumsum(edges[:-1]) > 0


def apply(spec, group):
    def run(left, right):
        bv.release()
        n = left.num_rows
        n_units, removed, spans, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n
        for c, mask in covered(spec, left, right):
            opens = mask & ~np.concatenate(([False], mask[:-1]))
            for d, (lo, hi) in enumerate(zip(c.offs[:-1].tolist(), c.offs[1:].tolist(), strict=True)):
                row, m = c.lo + d, mask[lo:hi]
                n_units[row], removed[row] = hi - lo, m.sum()
                spans[row] = opens[lo:hi].sum() + (hi > lo and m[0] and not opens[lo])
                if spec.words:
                    keep = np.flatnonzero(~m) + lo
                    raw = c.buf.tobytes() if d == 0 else raw
                    kept[row] = b" ".join([raw[x:y] for x, y in zip(c.spans[0][keep].tolist(), c.spans[1][keep].tolist(), strict=True)])
                else:
                    kept[row] = c.buf[lo:hi][~m].tobytes()
        out = left.drop_columns([group])
        for name, values in (("n_units", n_units), ("n_removed", removed), ("n_spans", spans)):
            out = out.append_column(name, pa.array(values))
        return out.append_column("kept", pa.array(kept, pa.binary()))

    return run


def remove_repeats(docs: DataFrame, spec: Spec) -> DataFrame:
    """docs with n_units, n_removed, n_spans (long) and kept (binary): what stays of each text.

    Columns of docs with these names are replaced.
    """
    docs = docs.drop("n_units", "n_removed", "n_spans", "kept")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = text_bytes(docs)
    n_groups, n_shards = max(2 * parts, size // GROUP_BYTES), max(parts, size // SHARD_BYTES)
    (group,) = unused(docs, "group")
    want = size // TASK_BYTES
    spread = lambda df, key: df.repartition(want, key) if want > parts else df
    dealt = spread(docs.withColumn(group, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups))), group)
    groups = dealt.groupBy(group)
    classes = spread(groups.applyInArrow(summarize(spec, n_shards, group), SUMMARY_DDL), "shard").groupBy("shard").applyInArrow(resolve(spec), REPLY_DDL)
    asked = groups.cogroup(spread(classes, "_b").groupBy("_b")).applyInArrow(fetch(spec, n_shards, group), SUMMARY_DDL)
    ranges = spread(asked, "shard").groupBy("shard").applyInArrow(compare(spec), REPLY_DDL)
    extra = [T.StructField(n, T.LongType()) for n in ("n_units", "n_removed", "n_spans")]
    schema = T.StructType([*docs.schema.fields, *extra, T.StructField("kept", T.BinaryType())])
    return groups.cogroup(spread(classes.unionByName(ranges), "_b").groupBy("_b")).applyInArrow(apply(spec, group), schema)
