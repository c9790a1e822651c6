"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's sketch is the k least hashes of its distinct shingles. Inverted lists are keyed by two
consecutive sketch values: what two documents share of the bottom k of their union stands side by
side in both sketches, and a run, unlike a single frequent value, has few unrelated documents.

  1. overlaps: a linked pair shares at least `shared_runs` lists, so rows with fewer lists in common
     with others drop out before anything is compared;
  2. each list meets its most central member; a pair stays if its union-sketch estimate lies within
     `slack` deviations of the threshold, and exact Jaccard on the full sets confirms it;
  3. links give components; lists that still hold several components go through 1 again;
  4. the rest is compared exactly: members outside a list's main component with that component, once
     for all lists, and with each other list by list, in groups of bounded size. A member leaves out
     as many of its longest lists as it may lack (prefix filter); one component is never compared.

Only steps 1 and 2 rest on chance: of pairs exactly at the threshold, `loss` share fewer lists and
2e-8 are estimated six deviations too low (k = 64). slack=None compares without the estimate, and with
loss=None one shared list is enough to be compared (2e-19 of pairs at the threshold share none). Sets of
up to k shingles are compared exactly. Equal sets meet without comparison, by a 128-bit set hash. Only
texts of candidates are shuffled; a text must fit a task, a long one takes a group for itself.

Null, empty or blank text has an empty set, linked with nothing. A row is a node of its own, named by
63 bits of a hash of id and text; rows that meet in these but differ in 64 further bits are named anew
(`clashes`), so only rows equal in both share a node, and neither null ids nor one id with several texts
tie documents together. A component has the least doc_id of its rows (null where
all are null) and a first row (least id, then least name; nulls last). kept holds for rows with the
component's id, or where that is null for the first row and rows equal to it; one_of_each leaves a
single row. An empty table gives an empty result. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesvec as bv
from .common import Scratch, table, unused

THRESHOLD, SKETCH, SHINGLE, BLOCK = (80, 100), 64, 2, 512
LAST = 2**63 - 1
#: Names met by different rows, of which so many are broadcast; more are joined by merging.
SMALL = 10_000
#: Deviations of the union-sketch estimate, and the chance that a linked pair shares fewer runs.
SLACK, LOSS = 6.0, 1e-9
CHUNK_BYTES = 200_000
#: Shingles of one side of a group, and of one pass of its exact comparison.
BLOCK_SHINGLES, PASS_SHINGLES = 4_000_000, 2_000_000


def shingles(texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every distinct shingle, sorted; hashes as int64."""
    buf, offs = bv.buffer_of(texts)
    low = bv.LOWER[buf]
    starts, ends, woffs = bv.word_spans(low, offs)
    words = bv.word_hashes(low, starts, ends)
    n = np.diff(woffs)
    grams = bv.gram_hashes(words, woffs, size)
    whole = np.flatnonzero((n > 0) & (n < size))  # fewer words: the whole sequence is one shingle
    if len(whole):
        sums = bv.prefix_sums(words)
        grams[woffs[whole]] = bv.mix(bv.span_hash(sums, woffs[whole], woffs[whole + 1]) ^ np.uint64(0x5BD1E995))
    ok = grams != bv.NONE
    doc, h = np.repeat(np.arange(len(n)), n)[ok], grams[ok].view(np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.empty(0, bool)
    return doc[new], h[new]


def _parts(column):
    lens = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lens) // CHUNK_BYTES
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(lens) else np.empty(0, np.int64)
    return zip(cut.tolist(), [*cut[1:].tolist(), len(lens)], strict=True) if len(lens) else ()


def _sketch(k, size):
    def run(batches):
        for batch in batches:
            for lo, hi in _parts(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                doc, h = shingles(part.column("text"), size)
                n = np.bincount(doc, minlength=part.num_rows)
                begin = np.cumsum(n) - n
                rank = np.arange(len(h)) - np.repeat(begin, n)
                u = h.view(np.uint64)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(bv.mix(u ^ np.uint64(s))))) for s in (11, 29)]
                s1, s2 = ((x[begin + n] - x[begin]).view(np.int64) for x in sums)
                kept = np.minimum(n, k)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))).astype(np.int32)), pa.array(h[rank < k]))
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("check"), part.column("id"), pa.array(n.astype(np.int64)), pa.array(s1), pa.array(s2), lists], ["doc", "check", "id", "n", "s1", "s2", "sketch"])

    return run


def sketches(docs: DataFrame, k: int = SKETCH, size: int = SHINGLE) -> DataFrame:
    """doc, check, id, n (distinct shingles), s1, s2 (set hash), sketch (the k least hashes, rising)."""
    return docs.select("doc", "check", "id", "text").mapInArrow(_sketch(k, size), "doc long, check long, id long, n long, s1 long, s2 long, sketch array<bigint>")


def run_keys(sketch: Column) -> Column:
    """Keys of the runs of two consecutive values."""
    at = lambda i: F.xxhash64(sketch[i], sketch[i + 1])
    return F.transform(F.sequence(F.lit(0), F.size(sketch) - 2), at)


def shared_runs(k: int, threshold, loss: float | None = LOSS) -> int:
    """Most runs of two that a pair at the threshold shares but with a chance of `loss`; one if it is None.

    Each of the k least values of the union is shared with the chance of the threshold; the counts of
    neighbours that are both shared follow step by step.
    """
    if loss is None:
        return 1
    t = threshold[0] / threshold[1]
    p = np.zeros((2, k + 1))  # by whether the last value is shared, and runs so far
    p[0, 0], p[1, 0] = 1 - t, t
    for _ in range(k - 1):
        p = np.stack((p.sum(axis=0) * (1 - t), (p[0] + np.append(0, p[1, :-1])) * t))
    return int(np.searchsorted(np.cumsum(p.sum(axis=0)), loss))


def needed_runs(n: Column, k: int, threshold, loss: float | None = LOSS) -> Column:
    """Runs that a set of n shingles shares with any linked one: whole sets of a union of u values lack
    at most (1 - t) u of them, each of which parts one run more than it takes."""
    t = threshold[0] / threshold[1]
    whole = F.ceil((2 * t - 1) * n - 1 - 1e-9)
    return F.greatest(F.lit(1), F.least(F.lit(max(1, shared_runs(k, threshold, loss))), whole)).cast("int")


def _padded(lists, k):
    """Rows of k values from a list array, filled up with LAST; and the lengths."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lens, values = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(lens), k), LAST)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
    return out, lens


def estimates(x, y, whole, k):
    """Jaccard estimates of pairs of padded sketches (rows of x and y) from the bottom k of their
    unions; from all values where both sketches are whole sets."""
    both = np.sort(np.concatenate((x, y), axis=1), axis=1)
    real = both != LAST
    again = np.zeros_like(real)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    distinct = real & ~again
    within = np.cumsum(distinct, axis=1) <= np.where(whole, 2 * k, k)[:, None]
    return (again & within).sum(axis=1) / np.maximum((distinct & within).sum(axis=1), 1)


def passes(x, y, na, nb, k, threshold, slack):
    """Whether pairs may reach the threshold by their estimates; exact where both sketches are sets."""
    t = threshold[0] / threshold[1]
    whole = (na <= k) & (nb <= k)
    sizes = np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9
    if slack is None:
        return sizes & (~whole | (estimates(x, y, whole, k) >= t - 1e-9))
    return sizes & (estimates(x, y, whole, k) >= t - np.where(whole, 1e-9, slack * np.sqrt(t * (1 - t) / k)))


def _estimated(k, threshold, slack):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 10_000):
                part = batch.slice(lo, 10_000)
                (x, _), (y, _) = _padded(part.column("a_sketch"), k), _padded(part.column("b_sketch"), k)
                ok = pa.array(passes(x, y, part.column("a_n").to_numpy(), part.column("b_n").to_numpy(), k, threshold, slack))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], ["a", "b"])

    return run


def _verified(size, threshold):
    def run(batches):
        for batch in batches:
            for lo, hi in _parts(batch.column("a_text")):
                part = batch.slice(lo, hi - lo)
                da, ha = shingles(part.column("a_text"), size)
                db, hb = shingles(part.column("b_text"), size)
                rows = part.num_rows
                na, nb = np.bincount(da, minlength=rows), np.bincount(db, minlength=rows)
                d, h = np.concatenate((da, db)), np.concatenate((ha, hb))
                order = np.lexsort((h, d))
                d, h = d[order], h[order]
                twice = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
                both = np.bincount(d[1:][twice], minlength=rows)
                ok = (threshold[1] * both >= threshold[0] * (na + nb - both)) & (na > 0) & (nb > 0)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(ok)), part.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def _spread_least(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (least node reachable): neighbours' least labels and pointer jumping until stable."""
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")), "labels")
    while True:
        near = both.join(grown(labels), F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("node").alias("at"), F.col("comp").alias("jump"))
        step = labels.join(grown(near), labels["node"] == near["a"]).join(grown(jump), F.col("comp") == F.col("at"), "left")
        new = scratch.table(step.select("node", F.col("comp").alias("old"), F.least("comp", "near", F.coalesce("jump", "comp")).alias("comp")), "labels")
        stable = new.where("old <> comp").isEmpty()
        scratch.drop(labels)
        labels = new
        if stable:
            scratch.drop(both)
            return labels.drop("old")


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents: never broadcast, not even where it is still small."""
    return df.hint("merge")


def _relabel(df, labels, column, name):
    named = grown(labels).select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return df.join(named, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_comp", column)).drop("_node", "_comp")


def merged(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (node, comp) after further links (a, b): only components are walked, not their nodes."""
    if labels is None:
        return _spread_least(links, scratch)
    ends = _relabel(_relabel(links, labels, "a", "ca"), labels, "b", "cb")
    found = _spread_least(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), scratch)
    old = _relabel(labels, found, "comp", "comp")
    return scratch.table(old.unionByName(found.join(grown(labels), "node", "left_anti").select("node", "comp")), "labels")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (least node reachable) of the nodes of edges (a, b)."""
    return merged(None, edges, scratch)


def _common(owner, values, m):
    """Values that each two of m members share: products of 0/1 columns, some columns at a time."""
    order = np.lexsort((owner, values))
    owner, values = owner[order], values[order]
    opens = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.empty(0, bool)
    column = np.cumsum(opens) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else opens
    owner, column = owner[shared], np.cumsum(opens[shared]) - 1 if shared.any() else column[:0]
    out = np.zeros((m, m), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        at = slice(*np.searchsorted(column, [lo, lo + 4096]))
        cells = np.zeros((m, 4096), np.float32)
        cells[owner[at], column[at] - lo] = 1
        out += cells @ cells.T
    return out.astype(np.int64)


def _apart(rows):
    """Pairs of a group to compare: of different components and, but in a solo group, of both sides."""
    comp, side = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "side"))
    solo = rows.column("kind")[0].as_py() == "list" and rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    return np.triu((comp[:, None] != comp) & (solo | (side[:, None] != side)), 1)


GROUP = ["kind", "key", "i", "j"]


def _likely(k, threshold, slack):
    """Members of a group that pass the estimate with a member of another component."""

    def run(rows):
        n = rows.column("n").to_numpy(zero_copy_only=False)
        padded, lens = _padded(rows.column("sketch"), k)
        near = _apart(rows)
        if slack is not None:
            owner = np.repeat(np.arange(len(n)), lens)
            near &= 2 * _common(owner, padded[padded != LAST], len(n)) >= np.minimum(lens[:, None], lens)
        a, b = np.nonzero(near)
        keep = np.zeros(len(n), bool)
        for lo in range(0, len(a), 20_000):
            x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
            ok = passes(padded[x], padded[y], n[x], n[y], k, threshold, slack)
            keep[x[ok]] = keep[y[ok]] = True
        return rows.select([*GROUP, "node", "comp", "side"]).filter(pa.array(keep))

    return run


def _exact(size, threshold):
    """Links of a group between components, by the full sets; hash range by hash range if they are large."""

    def run(rows):
        node, text, m = rows.column("node").to_numpy(), rows.column("text").combine_chunks(), rows.num_rows
        n_passes = 1 + int(rows.column("n").to_numpy().sum()) // PASS_SHINGLES
        n, common = np.zeros(m, np.int64), np.zeros((m, m), np.int64)
        for at in range(n_passes):
            got = []
            for lo, hi in _parts(text):
                doc, h = shingles(text.slice(lo, hi - lo), size)
                mine = h.view(np.uint64) % np.uint64(n_passes) == np.uint64(at)
                got.append((doc[mine] + lo, h[mine]))
            doc, h = (np.concatenate(x) for x in zip(*got, strict=True))
            n += np.bincount(doc, minlength=m)
            common += _common(doc, h, m)
        a, b = np.nonzero(_apart(rows) & (threshold[1] * common >= threshold[0] * (n[:, None] + n - common)) & (common > 0))
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    return run


def row_name() -> Column:
    """Name of a row, by its id and text; never null or negative."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").bitwiseAND(F.lit(LAST))


def row_check() -> Column:
    """64 bits of id and text beside the name."""
    return F.xxhash64(F.lit("row"), "text", F.col("doc_id").cast("long"))


def clashes(rows: DataFrame) -> DataFrame:
    """Names (doc) that rows of different checks share.

    Of 3e10 rows some fifty are expected to meet. Named anew by name and check, one of them meets a
    further row with a chance of 2e-7.
    """
    return rows.groupBy("doc").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("doc")


def renamed(df: DataFrame, met: DataFrame | None, name: str, check: str) -> DataFrame:
    """df with other names for rows whose name clashes."""
    if met is None:
        return df
    (other,) = unused(df, "met")
    joined = df.join(met.select(F.col("doc").alias(other)), F.col(name) == F.col(other), "left")
    again = F.xxhash64(name, check).bitwiseAND(F.lit(LAST))
    return joined.withColumn(name, F.when(F.col(other).isNotNull(), again).otherwise(F.col(name))).select(df.columns)


def _overlapping(rows: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """node, need, comp, key, size: rows of lists that hold several components, of nodes with at least
    as many such lists as they share with a linked one."""
    held = rows.withColumn("comp", F.col("node")) if labels is None else _relabel(rows.select("node", "need", "key"), labels, "node", "comp")
    lists = held.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "size")
    met = F.count("*").over(Window.partitionBy("node"))
    return scratch.table(held.join(grown(lists), "key").withColumn("met", met).where("met >= need").select("node", "need", "comp", "key", "size"), "overlaps")


def _blocks(members: DataFrame, by: list[str], block: int, name: str) -> DataFrame:
    """by, name: blocks that the members (with n) of each group fill, by their number and shingles."""
    load = F.greatest(F.count("*") / F.lit(block), F.sum("n") / F.lit(BLOCK_SHINGLES))
    return members.groupBy(*by).agg(F.ceil(load).cast("int").alias(name))


def _groups(rows: DataFrame, own: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """kind, key, i, j, node, comp, side, n: bounded groups that hold every pair of lists still apart.

    main: a component with the members of other components that meet it in a list where it is the
    largest. list: the members of a list outside that component. Of its lists of this kind a member
    leaves out the longest `need` - 1: a linked pair that meets in no main group shares `need` of them.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("of"))
    largest = sizes.groupBy("key").agg(F.max_by(F.struct("comp", "of"), F.struct("of", -F.col("comp"))).alias("m"))
    largest = largest.select("key", F.when(F.col("m.of") > 1, F.col("m.comp")).alias("main"))
    marked = scratch.table(rows.join(grown(largest), "key").where("main is null or comp <> main"), "marked")
    sized = own.select("node", "n")
    outer = scratch.table(marked.where("main is not null").select("main", "node", "comp").distinct().join(grown(sized), "node"), "outer")
    inner = rows.select(F.col("comp").alias("main"), "node", "comp").distinct().join(grown(outer.select("main").distinct()), "main", "left_semi").join(grown(sized), "node")
    n_outer, n_inner = _blocks(outer, ["main"], block, "ni"), _blocks(inner, ["main"], block, "nj")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    mine = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), n.cast("long")).cast("int")
    named = lambda kind, i, j, side: [F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side")]
    held = outer.withColumn("key", F.col("main")).join(grown(n_outer.join(grown(n_inner), "main")), "main")
    one = held.withColumn("to", F.explode(upto(F.col("nj")))).select("key", "node", "comp", "n", *named("main", mine(F.col("ni")), F.col("to"), F.lit(True)))
    held = inner.withColumn("key", F.col("main")).join(grown(n_outer.join(grown(n_inner), "main")), "main")
    two = held.withColumn("to", F.explode(upto(F.col("ni")))).select("key", "node", "comp", "n", *named("main", F.col("to"), mine(F.col("nj")), F.lit(False)))

    lists = marked.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "size")
    by_length = Window.partitionBy("node").orderBy("size", "key")
    every = by_length.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    short = marked.drop("size").join(grown(lists), "key").withColumns({"rank": F.row_number().over(by_length), "of": F.count("*").over(every)}).where(F.col("rank") <= F.col("of") - F.col("need") + 1)
    short = scratch.table(short.select("key", "node", "comp"), "short")
    alike = short.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"))
    once = alike.where("lo <> hi").groupBy("members", "size").agg(F.min("key").alias("key")).select("key")
    listed = scratch.table(short.join(grown(once), "key").join(grown(sized), "node"), "lists")
    held = listed.join(grown(_blocks(listed, ["key"], block, "ni")), "key").withColumn("c", mine(F.col("ni"))).withColumn("to", F.explode(upto(F.col("ni"))))
    three = held.select("key", "node", "comp", "n", *named("list", F.least("c", "to"), F.greatest("c", "to"), F.col("c") <= F.col("to")))
    return one.unionByName(two).unionByName(three)


def _linked(rows: DataFrame, reps: DataFrame, texts_of, threshold, k: int, size: int, block: int, slack: float | None, scratch: Scratch) -> DataFrame:
    """node, comp of linked nodes; rows are the overlaps, reps the sketches, texts_of(nodes) their texts."""
    nodes = scratch.table(rows.select("node").distinct(), "nodes")
    own = scratch.table(reps.join(grown(nodes), "node", "left_semi"), "own")
    texts = scratch.table(texts_of(nodes), "texts")
    salts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def beside(pairs, what):
        """pairs with the columns of both ends; many pairs meet one hub b, so that end is salted."""
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)))
        end = lambda name: what.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in what.columns if c != "node"])
        hubs = salted.select("b", "salt").distinct().join(grown(end("b")), "b")
        return salted.join(grown(end("a")), "a").join(grown(hubs), ["b", "salt"]).drop("salt")

    def linked(pairs):
        likely = scratch.table(beside(pairs, own).mapInArrow(_estimated(k, threshold, slack), "a long, b long"), "likely")
        return scratch.table(beside(likely, texts).mapInArrow(_verified(size, threshold), "a long, b long"), "links")

    weight = rows.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = rows.join(grown(weight), "node").groupBy("key").agg(F.max_by(F.struct("node", "comp"), F.struct("weight", -F.col("node"))).alias("hub"))
    pairs = rows.join(grown(hubs), "key").where(F.col("comp") != F.col("hub.comp")).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    labels = components(linked(scratch.table(pairs, "pairs")), scratch)
    apart = _overlapping(rows, labels, scratch)
    scratch.drop(rows)
    if apart.isEmpty():
        return labels

    own_columns = own.select("node", "sketch")
    groups = scratch.table(_groups(apart, own, block, scratch), "groups")
    likely = groups.join(grown(own_columns), "node").groupBy(*GROUP).applyInArrow(_likely(k, threshold, slack), "kind string, key long, i int, j int, node long, comp long, side boolean")
    held = scratch.table(likely, "likely").join(grown(texts), "node").join(grown(own.select("node", "n")), "node")
    return merged(labels, scratch.table(held.groupBy(*GROUP).applyInArrow(_exact(size, threshold), "a long, b long").distinct(), "links"), scratch)


def _clusters(docs: DataFrame, threshold, k: int, size: int, block: int, slack: float | None, loss: float | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Sketches of all rows; node, component_id and first of linked nodes; nodes of several equal rows;
    clashing names."""
    scratch = Scratch()
    docs = docs.select(row_name().alias("doc"), row_check().alias("check"), F.col("doc_id").cast("long").alias("id"), "text")
    sketched = scratch.table(sketches(docs, k, size), "sketches")
    clashed = scratch.table(clashes(sketched), "clashes")
    n_clashes = clashed.count()
    met = None if n_clashes == 0 else F.broadcast(clashed) if n_clashes <= SMALL else grown(clashed)
    sk, docs = renamed(sketched, met, "doc", "check"), renamed(docs, met, "doc", "check")
    full = sk.where("n > 0")
    sets = full.groupBy("s1", "s2", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    members = scratch.table(full.select("doc", "s1", "s2", "n").join(grown(sets), ["s1", "s2", "n"]).groupBy("doc", "rep").agg(F.count("*").alias("rows")), "copies")
    repeats = scratch.table(members.where("rows > 1").select("doc"), "repeats")
    repeated = not repeats.isEmpty()

    def once(df):
        """df with one row of each node."""
        return df.join(grown(repeats), "doc", "left_anti").unionByName(df.join(grown(repeats), "doc", "left_semi").dropDuplicates(["doc"])) if repeated else df

    reps = once(full.where("n > 3").join(grown(members.where("doc <> rep")), "doc", "left_anti").select("doc", "n", "sketch")).withColumnRenamed("doc", "node")
    keyed = reps.select("node", needed_runs(F.col("n"), k, threshold, loss).alias("need"), F.explode(run_keys(F.col("sketch"))).alias("key"))
    rows = _overlapping(keyed, None, scratch)
    if rows.isEmpty():
        labels = docs.sparkSession.createDataFrame([], "node long, comp long")
    else:
        texts = lambda nodes: once(docs.join(grown(nodes), F.col("doc") == F.col("node"), "left_semi").select("doc", "text")).withColumnRenamed("doc", "node")
        labels = _linked(rows, reps, texts, threshold, k, size, block, slack, scratch)

    homes = _relabel(members.select(F.col("doc").alias("node"), "rep"), labels, "rep", "comp").select("node", "comp")
    homes = scratch.table(homes.unionByName(labels.select("node", "comp").join(grown(members.select(F.col("doc").alias("node"))), "node", "left_anti")), "homes")
    least = homes.join(grown(sk.select(F.col("doc").alias("node"), "id")), "node").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least"))
    final = scratch.table(homes.join(grown(least), "comp").select("node", F.col("least.id").alias("component_id"), (F.col("node") == F.col("least.node")).alias("first")), "final")
    scratch.discard(sketched, final, repeats, *([clashed] if n_clashes else []))
    return sk, final, repeats, met


def near_duplicates(docs: DataFrame, threshold=THRESHOLD, k: int = SKETCH, size: int = SHINGLE, block: int = BLOCK, slack: float | None = SLACK, loss: float | None = LOSS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    sk, labels, _, _ = _clusters(docs, threshold, k, size, block, slack, loss)
    done = sk.select("doc", "id", "n").join(grown(labels), F.col("doc") == F.col("node"), "left")
    ids = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), "first", F.lit(True))
    return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), ids.alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, threshold=THRESHOLD, k: int = SKETCH, size: int = SHINGLE, block: int = BLOCK, slack: float | None = SLACK, loss: float | None = LOSS) -> DataFrame:
    """docs with a single row of each component: its first, of equal rows the least by all columns."""
    _, labels, repeats, met = _clusters(docs, threshold, k, size, block, slack, loss)
    name, check, other, least = unused(docs, "name", "check", "other", "least")
    named = renamed(docs.withColumns({name: row_name(), check: row_check()}), met, name, check).join(grown(labels.where("not first").select(F.col("node").alias(other))), F.col(name) == F.col(other), "left_anti")
    if repeats.isEmpty():
        return named.select(docs.columns)
    again = grown(repeats.select(F.col("doc").alias(other)))
    one = named.join(again, F.col(name) == F.col(other), "left_semi").groupBy(name).agg(F.min(F.struct(*docs.columns)).alias(least)).select(f"{least}.*")
    return named.join(again, F.col(name) == F.col(other), "left_anti").select(docs.columns).unionByName(one)


def op10(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT s.*, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY c.df, s.g) AS pos FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS df FROM s GROUP BY g) c USING (g)),
pre AS (SELECT * FROM rare WHERE pos <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
shared AS (SELECT a, b, na, nb, count(*) AS i FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY ALL),
e AS (SELECT a, b FROM shared WHERE 100 * i >= 80 * (na + nb - i)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, e2.b FROM reach JOIN e2 ON reach.r = e2.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.comp AS component_id, d.doc_id = c.comp AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT v, min(r) AS comp FROM reach GROUP BY v) c ON d.doc_id = c.v
"""
