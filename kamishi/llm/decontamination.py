"""Benchmark decontamination: a generalised suffix automaton of the test items reads every document.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and all other characters beyond
ASCII. A window is `window` consecutive words of an item, or the whole item where it is shorter; document
words inside any occurrence of a window are hit. The automaton of all items gives, at each word of a
document, the longest match that ends there; of its suffixes those as long as a window are looked up.
Documents are read in step, many at a time: only runs of words whose neighbours stand side by side in
some item can hold a match, and only those enter the automaton. Words meet by 64-bit hashes; those of
every reported window are compared byte by byte. Runs of hit words are removed, and a document more of
whose words are hit than a share allows goes as a whole.

Items are cut into pieces that overlap by a window but one word, which have the same windows, and dealt
into blocks of a bounded number of words. Documents are read once for each block; only one block's
automaton is broadcast at a time, and between blocks the rows are written to the shared folder.

Null or empty texts have no words and are hit by nothing, and such items hit nothing. Items that share an
id are one item; a null id is the item ''. Rows of documents are judged one by one, so repeated rows and
null ids get their own answers; a text of any length is one row, and runs longer than CHUNK words are
read in overlapping chunks. Empty tables give an empty or a clean result. Other columns pass through,
whatever their names; the result's own are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesvec as bv
from .common import Scratch, table
from .line_dedup import LOWER, UPPER

WINDOW = 10
#: Words of items that one automaton holds (about 50 bytes each), and of a piece of an item.
BLOCK_WORDS, PIECE_WORDS = 500_000, 4096
#: Words of a run that are read in step before it is cut.
CHUNK = 512
SLICE_BYTES = 8 << 20

NO_WORD = np.ones(256, bool)
NO_WORD[48:58] = NO_WORD[97:123] = NO_WORD[128:] = False
NO_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted value in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass(frozen=True)
class Automaton:
    """Words are numbers by hash; (state, word) and (state, window length) are looked up in sorted keys."""

    hashes: np.ndarray  # sorted, one for each word of the items
    spelled: np.ndarray  # bytes of the words in that order
    at: np.ndarray  # their offsets
    pairs: np.ndarray  # first * words + second of neighbours
    keys: np.ndarray  # state * words + word
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    lengths: tuple[int, ...]  # of windows, longest first
    width: int  # greater than any length
    windows: np.ndarray  # state * width + length
    item_at: np.ndarray  # offsets of each window's items
    items: np.ndarray  # numbers of items
    ids: tuple[str, ...]  # sorted

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if no item has it."""
        at, found = _find(self.hashes, hashes)
        return np.where(found, at, -1)


def _states(sequences) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Transitions, suffix links and lengths of the generalised suffix automaton, word by word."""
    moves, link, length = [{}], [-1], [0]

    def state(moved, to, n):
        moves.append(moved)
        link.append(to)
        length.append(n)
        return len(moves) - 1

    def parted(p, word, q):
        """The state of exactly length[p] + 1 words that word leads to from p: q, or its shorter part."""
        if length[q] == length[p] + 1:
            return q
        new = state(dict(moves[q]), link[q], length[p] + 1)
        link[q] = new
        while p >= 0 and moves[p].get(word) == q:
            moves[p][word] = new
            p = link[p]
        return new

    for sequence in sequences:
        last = 0
        for word in sequence:
            if word in moves[last]:
                last = parted(last, word, moves[last][word])
                continue
            new, p = state({}, 0, length[last] + 1), last
            while p >= 0 and word not in moves[p]:
                moves[p][word] = new
                p = link[p]
            if p >= 0:
                link[new] = parted(p, word, moves[p][word])
            last = new
    return moves, link, length


def build(items: list[tuple[str, list[str]]], window: int = WINDOW) -> Automaton:
    """The automaton of (id, words) pieces; a piece shorter than the window is a window by itself."""
    known = sorted({w.encode() for _, words in items for w in words})
    spelled, ends = np.frombuffer(b"".join(known), np.uint8), np.cumsum([0, *map(len, known)])
    hashes = bv.word_hashes(spelled, ends[:-1], ends[1:]) if known else np.empty(0, np.uint64)
    order = np.argsort(hashes)
    if len(np.unique(hashes)) < len(known):
        raise ValueError("two words of the items share a hash")
    known = [known[i] for i in order]
    number = {w.decode(): i for i, w in enumerate(known)}
    sequences = [[number[w] for w in words] for _, words in items]
    moves, link, length = _states(sequences)
    ids = sorted({i for i, _ in items})
    place = {i: k for k, i in enumerate(ids)}
    found: dict[tuple[int, int], set[int]] = {}
    for (item, _), sequence in zip(items, sequences, strict=True):
        s, size = 0, min(window, len(sequence))
        for n, word in enumerate(sequence, 1):
            s = moves[s][word]
            while length[link[s]] >= size:  # the state of the last size words
                s = link[s]
            if n >= size:
                found.setdefault((s, size), set()).add(place[item])
    n = max(len(known), 1)
    edges = sorted((s * n + w, to) for s, moved in enumerate(moves) for w, to in moved.items())
    lengths = tuple(sorted({size for _, size in found}, reverse=True))
    kept = sorted((s * (window + 1) + size, sorted(who)) for (s, size), who in found.items())
    pairs = {a * n + b for x in sequences for a, b in zip(x, x[1:], strict=False)}
    return Automaton(
        hashes[order], np.frombuffer(b"".join(known), np.uint8), np.cumsum([0, *map(len, known)]), np.array(sorted(pairs), np.int64),
        np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64), np.array(link), np.array(length), lengths, window + 1,
        np.array([k for k, _ in kept], np.int64), np.cumsum([0, *(len(w) for _, w in kept)]), np.array([i for _, w in kept for i in w], np.int64), tuple(ids),
    )


def _runs(a: Automaton, words: np.ndarray, last_of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the maximal runs of known words whose neighbours stand side by side in an item,
    those too short for any window left out, long ones cut into overlapping chunks."""
    known = words >= 0
    joined = known[:-1] & known[1:] & ~last_of_text[:-1]
    at = np.flatnonzero(joined)
    joined[at] = _find(a.pairs, words[at] * max(len(a.hashes), 1) + words[at + 1])[1]
    opens = np.flatnonzero(known & np.append(True, ~joined))
    size = np.flatnonzero(known & np.append(~joined, True)) + 1 - opens
    long = size >= a.lengths[-1]
    opens, size = opens[long], size[long]
    shared = a.lengths[0] - 1
    chunks = np.maximum(1, -(-(size - shared) // CHUNK))
    part = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return np.repeat(opens, chunks) + part * CHUNK, np.minimum(np.repeat(size, chunks) - part * CHUNK, CHUNK + shared)


def longest_matches(a: Automaton, words: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, state, length of the longest match that ends there) of all words of the runs."""
    order = np.argsort(-lens, kind="stable")
    starts, lens, n = starts[order], lens[order], max(len(a.hashes), 1)
    state, match = np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
    out = []
    for t in range(int(lens[0]) if len(lens) else 0):
        live = int(np.searchsorted(-lens, -t))
        word, todo = words[starts[:live] + t], np.arange(live)
        while len(todo):
            at, found = _find(a.keys, state[todo] * n + word[todo])
            hit = todo[found]
            state[hit] = a.targets[at[found]]
            match[hit] += 1
            todo = todo[~found]  # the root knows every word, so these have a link
            state[todo] = a.link[state[todo]]
            match[todo] = a.length[state[todo]]
        out.append((starts[:live] + t, state[:live].copy(), match[:live].copy()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def find_windows(a: Automaton, words: np.ndarray, last_of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last word, length, number) of every occurrence of a window."""
    none = np.empty(0, np.int64)
    if not a.lengths or not len(words):
        return none, none, none
    at, state, match = longest_matches(a, words, *_runs(a, words, last_of_text))
    long = match >= a.lengths[-1]
    at, state, match = at[long], state[long], match[long]
    out = [(none, none, none)]
    for size in a.lengths:
        live = np.flatnonzero(match >= size)
        up = live
        while len(up):  # to the state of the last size words
            up = up[a.length[a.link[state[up]]] >= size]
            state[up] = a.link[state[up]]
        place, found = _find(a.windows, state[live] * a.width + size)
        out.append((at[live[found]], np.full(int(found.sum()), size), place[found]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _verified(a: Automaton, buf, starts, ends, words, at, size, window):
    """The occurrences whose words are those of the items, byte by byte."""
    change = np.bincount(at - size + 1, minlength=len(words) + 1) - np.bincount(at + 1, minlength=len(words) + 1)
    held = np.flatnonzero(np.cumsum(change)[: len(words)] > 0)
    word = words[held]
    lens = ends[held] - starts[held]
    same = lens == a.at[word + 1] - a.at[word]
    held, word, lens = held[same], word[same], lens[same]
    owner = np.repeat(np.arange(len(held)), lens)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)
    wrong = np.bincount(owner, buf[starts[held][owner] + k] != a.spelled[a.at[word][owner] + k], len(held)) if len(held) else np.empty(0)
    good = np.zeros(len(words) + 1, np.int64)
    good[1:][held[wrong == 0]] = 1
    total = np.cumsum(good)
    whole = total[at + 1] - total[at + 1 - size] == size
    return at[whole], size[whole], window[whole]


def scan(a: Automaton, texts):
    """(buf, offs, starts, ends, word offsets, hit, document, item) of a string array: words and whether
    each is hit, and all pairs of a document and an item with an occurring window."""
    buf, offs = bv.buffer_of(texts)
    low = bv.LOWER[buf]
    starts, ends, woffs = bv.word_spans(low, offs, NO_WORD)
    words = a.words(bv.word_hashes(low, starts, ends))
    last = np.zeros(len(words), bool)
    last[woffs[1:][np.diff(woffs) > 0] - 1] = True
    at, size, window = _verified(a, low, starts, ends, words, *find_windows(a, words, last))
    change = np.bincount(at - size + 1, minlength=len(words) + 1) - np.bincount(at + 1, minlength=len(words) + 1)
    doc = np.searchsorted(woffs, at, "right") - 1
    both = np.unique(doc * max(len(a.windows), 1) + window)
    doc, window = np.divmod(both, max(len(a.windows), 1))
    n = np.diff(a.item_at)[window]
    item = a.items[np.arange(n.sum()) + np.repeat(a.item_at[window] - np.cumsum(n) + n, n)]
    doc, item = np.divmod(np.unique(np.repeat(doc, n) * max(len(a.ids), 1) + item), max(len(a.ids), 1))
    return buf, offs, starts, ends, woffs, np.cumsum(change)[: len(words)] > 0, doc, item


SPANS = T.ArrayType(T.StructType([T.StructField(f, T.IntegerType()) for f in ("first", "end", "from_byte", "to_byte")]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)]


def _read(shared, clean: bool):
    """Adds n_words, items and spans, with those that an earlier block has found, and the text without the spans."""

    def run(batches):
        a = shared.value
        for batch in batches:
            for lo, hi in bv.slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                buf, offs, starts, ends, woffs, hit, doc, item = scan(a, part.column("text"))
                held = [[] for _ in range(part.num_rows)]
                if "items" in part.schema.names:
                    held = part.column("items").to_pylist()
                    old = part.column("spans")
                    base = np.repeat(woffs[:-1], old.value_lengths().to_numpy())
                    first, end = (old.flatten().field(i).to_numpy() + base for i in (0, 1))
                    hit |= np.cumsum(np.bincount(first, minlength=len(hit) + 1) - np.bincount(end, minlength=len(hit) + 1))[: len(hit)] > 0
                for d, i in zip(doc.tolist(), item.tolist(), strict=True):
                    held[d].append(a.ids[i])
                edge = np.zeros(len(hit) + 1, bool)
                edge[woffs] = True
                opens = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
                closes = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False)))
                at = np.searchsorted(opens, woffs)
                owner = np.repeat(np.arange(part.num_rows), np.diff(at))
                cols = [opens - woffs[owner], closes + 1 - woffs[owner], starts[opens] - offs[owner], ends[closes] - offs[owner]]
                spans = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in cols], ["first", "end", "from_byte", "to_byte"]))
                found = [pa.array(np.diff(woffs)), pa.array([sorted(set(x)) for x in held], pa.list_(pa.string())), spans]
                names = [f.name for f in FOUND]
                if clean:
                    gone = np.cumsum(np.bincount(starts[opens], minlength=len(buf) + 1) - np.bincount(ends[closes], minlength=len(buf) + 1))[: len(buf)] > 0
                    kept = np.concatenate(([0], np.cumsum(~gone)))[offs]
                    text = pa.Array.from_buffers(pa.large_string(), part.num_rows, [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(buf[~gone].tobytes())])
                    found.append(pa.array(text.to_pylist(), pa.string(), mask=part.column("text").is_null().to_numpy(zero_copy_only=False)))
                    names.append("clean_text")
                keep = [c for c in part.schema.names if c not in names]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *found], [*keep, *names])

    return run


def _pieces(items: DataFrame, window: int, piece_words: int) -> DataFrame:
    """item (string) and words of overlapping pieces of the items, none of them empty."""
    words = F.array_remove(F.split(F.translate("text", UPPER, LOWER), NO_WORD_CLASS), "")
    read = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("ws")).where(F.size("ws") > 0)
    opens = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)), F.lit(piece_words))
    return read.select("item", "ws", F.explode(opens).alias("at")).select("item", F.slice("ws", F.col("at") + 1, F.lit(piece_words + window - 1)).alias("words"))


def automata(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> Iterator[Automaton]:
    """Automata of the items (item_id, text), each of about block_words words at most, one by one."""
    pieces = _pieces(items, window, piece_words)
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // block_words)
    for block in range(max(blocks, 1)):
        mine = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block) if blocks > 1 else pieces
        yield build([(r.item, r.words) for r in mine.collect()], window)  # a block


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_share: float | None = None, clean: bool = True, block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """docs with n_words, n_hit, items (ids, sorted), spans (hit runs, in words and in bytes), contaminated,
    kept (false where more than max_share of the words are hit) and, if clean, clean_text."""
    docs = docs.drop("n_words", "n_hit", "items", "spans", "contaminated", "kept", "clean_text")
    scratch, names = Scratch(), {f.name for f in FOUND}
    out, spark = docs, docs.sparkSession
    waiting = None
    for automaton in automata(items, window, block_words, piece_words):
        if waiting is not None:
            before = out
            out = scratch.table(waiting, "decontamination")
            scratch.drop(before)
        schema = T.StructType([*(f for f in out.schema.fields if f.name not in names | {"clean_text"}), *FOUND, *([T.StructField("clean_text", T.StringType())] if clean else [])])
        waiting = out.mapInArrow(_read(spark.sparkContext.broadcast(automaton), clean), schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    share = F.lit(False) if max_share is None else F.col("n_hit") > max_share * F.col("n_words")
    return waiting.withColumn("n_hit", n_hit).withColumns({"contaminated": F.col("n_hit") > 0, "kept": ~share})


def op11(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), clean=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
w AS (
  SELECT DISTINCT item, n, array_to_string(ws[k + 1:k + n], ' ') AS g
  FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(0, greatest(len(ws) - 9, 1))) AS k FROM i WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
o AS (
  SELECT doc_id, n, k, array_to_string(ws[k + 1:k + n], ' ') AS g
  FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
h AS (SELECT o.doc_id, o.n, o.k, w.item FROM o JOIN w ON o.n = w.n AND o.g = w.g),
c AS (SELECT doc_id, count(DISTINCT k + r.x)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, n, k FROM h), range(0, 10) AS r(x) WHERE r.x < n GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
