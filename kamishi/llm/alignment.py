"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both tokenizers cut space + text. Where tokens of both end at one byte, the text falls into groups; a link
is a pair of token occurrences whose byte ranges overlap. Neither tokenizer merges across the start of a
space run, so a text is cut there into segments, and each distinct segment of a slice of rows (of
SLICE_BYTES of text, one text at least) is encoded and aligned once. DuckDB aligns the segments of a slice
inside the Arrow task: token interval tables, an ASOF join (the B token in which each A token starts) and a
range join (the B tokens that start inside an A token) for the links, window sums of common ends for the
groups. A slice gives its partial counts of linked id pairs, which Spark merges; the counts of the whole
corpus go back to the slices' pairs, from there to their segments and, slice by slice, to the texts.

A text is not aligned (counts of zero, empty groups) where it is null or empty, or where the bytes of
either's tokens are not space + text. Rows are judged one by one, so repeated rows and null ids each count.
A text of any length is one row; a segment (no space inside) must fit a task. An empty table gives an
empty result. Other columns pass through, whatever their names; the result's own are replaced.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesvec as bv
from .common import Scratch, table, unused

BYTE_FILE, PIECE_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE_BYTES = 4 << 20
#: Bytes of distinct segments that one round of DuckDB takes.
ROUND_BYTES = 1 << 18


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


#: Fixed value: how byte-level tokenizers split a text before they merge.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class ByteLevel:
    """A tokenizer by a JSON file whose entries stand for bytes; its content goes to the tasks.

    Where ids rise in the order of the merges, as they do in such files, ids are ranks, and the quicker of
    two libraries can merge by them.
    """

    content: str

    def open(self):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        held, byte = json.loads(self.content), _byte_of_character()
        vocabulary, added = held["model"]["vocab"], {t["content"]: t["id"] for t in held["added_tokens"]}
        spelled = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
        for entry, i in vocabulary.items():
            spelled[i] = entry.encode() if entry in added else bytes(byte[c] for c in entry)
        for entry, i in added.items():
            spelled[i] = entry.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        splits = held["pre_tokenizer"]
        if made == sorted(set(made)) and splits["type"] == "ByteLevel" and splits["use_regex"] and not splits["add_prefix_space"] and not held["normalizer"]:
            ranks = {spelled[i]: i for entry, i in vocabulary.items() if entry not in added}
            own = Encoding("byte level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
            return (lambda segments: [own.encode_ordinary(s) for s in segments]), spelled
        own = Tokenizer.from_str(self.content)
        own.encode_special_tokens = True
        return (lambda segments: [own.encode(s, add_special_tokens=False).ids for s in segments]), spelled


@dataclass(frozen=True)
class Pieces:
    """A tokenizer by a piece file; it puts a space in front of a text by itself."""

    content: bytes

    def open(self):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_proto=self.content)
        spelled = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace(MARK, " ").encode() for i in range(own.vocab_size())]
        return (lambda segments: own.encode([s[1:] for s in segments], num_threads=1)), spelled


def load(byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> tuple[ByteLevel, Pieces]:
    """Read both files on the driver."""
    with open(byte_file, encoding="utf-8") as a, open(piece_file, "rb") as b:
        return ByteLevel(a.read()), Pieces(b.read())


def segments(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, offsets of each text's segments) of space + text: a segment begins where a space
    follows anything but white space, unless that space is all that is left."""
    texts = pc.fill_null(texts, "")
    buf, own = bv.buffer_of(pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " "), texts, ""))
    full = np.diff(own) > 0
    back = lambda k: np.concatenate((np.zeros(k, np.uint8), buf[:-k])) if len(buf) > k else np.zeros(len(buf), np.uint8)
    x, y, z = back(1), back(2), back(3)
    white = (x == 32) | ((x >= 9) & (x <= 13)) | ((x >= 28) & (x <= 31)) | (y == 0xC2) & ((x == 0x85) | (x == 0xA0)) | (z == 0xE1) & (y == 0x9A) & (x == 0x80)
    white |= (z == 0xE2) & (y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF)) | (z == 0xE2) & (y == 0x81) & (x == 0x9F) | (z == 0xE3) & (y == 0x80) & (x == 0x80)
    cut = (buf == 32) & ~white
    cut[own[1:][full] - 1] = False
    cut[own[:-1][full]] = True
    starts = np.flatnonzero(cut)
    return buf, starts, np.searchsorted(starts, own)


@dataclass(frozen=True)
class Tokens:
    """Tokens of a row of segments: ids, offsets of each segment's, and of each token's bytes."""

    ids: np.ndarray
    at: np.ndarray
    ends: np.ndarray


def _encode(own, texts: list[str], wanted: np.ndarray, begins: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """Tokens of segments that lie at begins in the bytes wanted, and whether theirs are the same bytes."""
    encode, sizes, flat, flat_at = own
    found = encode(texts)
    count = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter(chain.from_iterable(found), np.int64, int(count.sum()))
    at = np.concatenate(([0], np.cumsum(count)))
    ends = np.cumsum(sizes[ids])
    total = np.concatenate(([0], ends))[at]
    same = np.diff(total) == np.diff(begins)
    seg = np.repeat(np.arange(len(texts)), count)
    live = same[seg]
    token, first = ids[live], (ends - sizes[ids] - total[seg] + begins[seg])[live]
    size = sizes[token]
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wrong = flat[np.repeat(flat_at[token], size) + k] != wanted[np.repeat(first, size) + k]
    same[np.repeat(seg[live], size)[wrong]] = False
    return Tokens(ids, at, ends), same


def _opened(tokenizer):
    encode, spelled = tokenizer.open()
    sizes = np.array([len(s) for s in spelled])
    return encode, sizes, np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(sizes) - sizes


LINKS = """
SELECT a.seg, a.id AS a_id, b.id AS b_id FROM a ASOF JOIN b ON a.lo >= b.lo
UNION ALL SELECT a.seg, a.id, b.id FROM a JOIN b ON b.lo > a.lo AND b.lo < a.hi"""
#: The group of each token of one side: how many common ends lie before it.
GROUPS = """
SELECT coalesce(sum(ends) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g
FROM (SELECT own.lo, (other.hi IS NOT NULL)::INT AS ends FROM {own} AS own LEFT JOIN {other} AS other ON own.hi = other.hi) ORDER BY lo"""


def _intervals(t: Tokens, seg: np.ndarray, lo: int, hi: int) -> pa.Table:
    """The token intervals of segments lo to hi."""
    part = slice(t.at[lo], t.at[hi])
    ends = t.ends[part]
    begins = np.concatenate((t.ends[t.at[lo] - 1 : t.at[lo]] if t.at[lo] else [0], ends[:-1])) if len(ends) else ends
    return pa.table({"seg": seg[part], "id": t.ids[part], "lo": begins, "hi": ends})


def _group_texts(a: pa.Table, b: pa.Table, in_a: np.ndarray, in_b: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, pa.Array]:
    """Groups of the segments lo to hi and their texts, from the groups of the tokens of either side."""
    ids, seg = (np.empty(len(in_a) + len(in_b), np.int64) for _ in range(2))
    before = np.empty(len(ids), object)
    places = np.arange(len(in_a)) + np.searchsorted(in_b, in_a), np.arange(len(in_b)) + np.searchsorted(in_a, in_b, "right")
    for side, held, g, place in zip(";|", (a, b), (in_a, in_b), places, strict=True):
        ids[place], seg[place] = held.column("id").to_numpy(), held.column("seg").to_numpy()
        before[place] = np.where(np.append(True, g[1:] != g[:-1]), side, ",") if len(g) else ","
    first = np.searchsorted(seg, np.arange(lo, hi + 1))
    opens = before == ";"
    before[first[:-1][np.diff(first) > 0]] = ""
    parts = pc.binary_join_element_wise(pa.array(before, pa.string()), pa.array(ids).cast(pa.string()), "")
    return np.add.reduceat(opens, first[:-1]) if hi > lo else np.empty(0, np.int64), pc.binary_join(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), parts), "")


def align_segments(con, a: Tokens, b: Tokens, n: int, cuts: list[int]):
    """(segment, A id, B id of each link, groups of each segment, their texts); cuts part the segments into rounds."""
    owner = [np.repeat(np.arange(n), np.diff(t.at)) for t in (a, b)]
    links, counts, texts = [], [], []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        sides = [_intervals(t, seg, lo, hi) for t, seg in zip((a, b), owner, strict=True)]
        for name, held in zip("ab", sides, strict=True):
            con.register(name, held)
        links.append(con.sql(LINKS).to_arrow_table())
        groups = [con.sql(GROUPS.format(own=x, other=y)).to_arrow_table().column("g").to_numpy() for x, y in ("ab", "ba")]
        count, text = _group_texts(*sides, *groups, lo, hi)
        counts.append(count)
        texts += text.to_pylist()
    cols = [np.concatenate([t.column(c).to_numpy() for t in links] or [np.empty(0, np.int64)]) for c in ("seg", "a_id", "b_id")]
    return *cols, np.concatenate(counts or [np.empty(0, np.int64)]).astype(np.int64), texts


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
OWN = [*COUNTS, "n_best", "count_sum"]
PAIR = T.StructType([T.StructField(c, T.LongType()) for c in ("a_id", "b_id", "n")])


def pack(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Lists of numbers as binaries, seven bits to a byte; frequent things have small numbers."""
    size = 1 + sum((values >= 1 << (7 * k)).astype(np.int64) for k in range(1, 5))
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        out[at[live] + k] = (values[live] >> (7 * k)) & 127 | (size[live] > k + 1) << 7
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at[offsets].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])


def unpack(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of packed lists."""
    packed = packed.cast(pa.large_binary())
    _, offs, data = packed.buffers()
    offs = np.frombuffer(offs, np.int64, len(packed) + 1, packed.offset * 8) if len(packed) else np.zeros(1, np.int64)
    data, offs = np.frombuffer(data, np.uint8, int(offs[-1] - offs[0]), int(offs[0])) if offs[-1] > offs[0] else np.empty(0, np.uint8), offs - offs[0]
    stops = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
    place = np.arange(len(data)) - np.repeat(starts, stops + 1 - starts)
    values = np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts) if len(stops) else stops
    return values, np.searchsorted(stops, offs)


def _aligned(con, sides, texts):
    """Of a slice of texts: the segments of each (packed), counts and group text of each, the slice's pairs
    with their numbers (struct array), and how many links each segment has and which pairs (packed)."""
    buf, starts, at = segments(texts)
    ends = np.append(starts[1:], len(buf))
    first, word = bv.alike(buf, starts, ends)
    lens = (ends - starts)[first]
    begins = np.concatenate(([0], np.cumsum(lens)))
    wanted = buf[np.repeat(starts[first] - begins[:-1], lens) + np.arange(begins[-1])]
    raw = wanted.tobytes()
    spelled = [raw[x:y].decode() for x, y in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    (a, ok), (b, fine) = (_encode(side, spelled, wanted, begins) for side in sides)
    whole = np.add.reduceat(np.append(~(ok & fine)[word], False).astype(np.int64), at[:-1]) * (np.diff(at) > 0) == 0 if len(at) > 1 else np.empty(0, bool)
    n = np.where(whole, np.diff(at), 0)
    used = np.repeat(whole, np.diff(at))
    word = word[used]
    kept, word = np.unique(word, return_inverse=True)  # segments of aligned texts only, all of them the same bytes
    weight = np.bincount(word, minlength=len(kept))
    kept, word, weight = _by_rank(kept, word, weight)
    a, b = (_chosen(t, kept) for t in (a, b))
    size = np.cumsum(lens[kept])
    cuts = [0, *(np.flatnonzero(np.diff(size // ROUND_BYTES)) + 1).tolist(), len(kept)] if len(kept) else [0]
    seg, a_id, b_id, n_groups, group_texts = align_segments(con, a, b, len(kept), cuts)
    order = np.argsort(seg, kind="stable")
    seg, a_id, b_id = seg[order], a_id[order], b_id[order]
    pair, place = np.unique(a_id << 32 | b_id, return_inverse=True)
    pair, place, times = _by_rank(pair, place, np.bincount(place, weight[seg], len(pair)).astype(np.int64))
    pairs = pa.StructArray.from_arrays([pa.array(x) for x in (pair >> 32, pair & 0xFFFFFFFF, times)], ["a_id", "b_id", "n"])
    links_at = np.searchsorted(seg, np.arange(len(kept) + 1))
    links = (pack(np.diff(links_at), np.array([0, len(kept)])), pack(place, np.array([0, len(place)])))
    own = np.concatenate(([0], np.cumsum(n)))
    total = lambda per_segment: np.diff(np.concatenate(([0], np.cumsum(per_segment[word])))[own])
    counts = [total(x) for x in (np.diff(a.at), np.diff(b.at), n_groups, np.diff(links_at))]
    spelled = [group_texts[w] for w in word.tolist()]
    groups = [";".join(spelled[x:y]) for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
    return pack(word, own), counts, groups, pairs, links


def _by_rank(things: np.ndarray, which: np.ndarray, times: np.ndarray):
    """(things, which, times) with things numbered from the most frequent on."""
    order = np.argsort(-times, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return things[order], rank[which], times[order]


def _chosen(t: Tokens, kept: np.ndarray) -> Tokens:
    """The tokens of some segments, whose bytes then lie side by side."""
    n = np.diff(t.at)[kept]
    at = np.concatenate(([0], np.cumsum(n)))
    place = np.arange(at[-1]) + np.repeat(t.at[kept] - at[:-1], n)
    sizes = np.diff(np.concatenate(([0], t.ends)))[place]
    return Tokens(t.ids[place], at, np.cumsum(sizes))


def _read(shared, digest: bool, own: dict[str, str], schema: pa.Schema):
    def run(batches):
        import duckdb

        sides = [_opened(t) for t in shared.value]
        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        base, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo, hi in bv.slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                words, counts, groups, pairs, links = _aligned(con, sides, part.column("text"))
                number += 1
                held = {c: part.column(c) for c in part.schema.names} | dict(zip(COUNTS, map(pa.array, counts), strict=True))
                held |= {"groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())} if digest else {"groups": pa.array(groups, pa.string())}
                yield _batch(schema, part.num_rows, held | {own["unit"]: pa.array(np.full(part.num_rows, base + number)), own["segs"]: words})
                one = dict(zip((own["sizes"], own["links"]), links, strict=True))
                yield _batch(schema, 1, one | {own["unit"]: pa.array([base + number]), own["pairs"]: pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs)})

    return run


def _batch(schema: pa.Schema, n: int, held: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([held[f.name].cast(f.type) if f.name in held else pa.nulls(n, f.type) for f in schema], schema=schema)


def _valued(own: dict[str, str], out: pa.Schema):
    """Texts of a slice with what the links of their segments add up to: how many are best and their counts."""

    def run(rows: pa.Table, counted: pa.Table) -> pa.Table:
        is_text = pc.is_valid(rows.column(own["segs"]))
        docs, one = rows.filter(is_text), rows.filter(pc.invert(is_text))
        sizes, links = (unpack(one.column(own[c]).combine_chunks())[0] for c in ("sizes", "links"))
        order = np.argsort(counted.column("pos").to_numpy())
        n, top = (counted.column(c).to_numpy()[order] for c in ("n", "top"))
        word, at = unpack(docs.column(own["segs"]).combine_chunks())
        found = {}
        for name, value in (("n_best", (n == top).astype(np.int64)), ("count_sum", n)):
            of_segment = np.diff(np.concatenate(([0], np.cumsum(value[links])))[np.concatenate(([0], np.cumsum(sizes)))])
            found[name] = pa.array(np.diff(np.concatenate(([0], np.cumsum(of_segment[word])))[at]))
        return pa.table([found[f.name] if f.name in found else docs.column(f.name) for f in out], schema=out)

    return run


def align(docs: DataFrame, tokenizers=None, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(docs with n_a, n_b, n_groups, n_links, n_best, count_sum and groups, all linked pairs a_id, b_id, n).

    groups is a text like `a1,a2|b1;a3|b2,b3`; with digest it is groups_sha256 instead, and text goes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, scratch = docs.sparkSession, Scratch()
    docs = docs.drop(*OWN, "groups", "groups_sha256")
    names = ["unit", "segs", "pairs", "sizes", "links"]
    own = dict(zip(names, unused(docs, *names), strict=True))
    text = "groups_sha256" if digest else "groups"
    longs = lambda names: [T.StructField(c, T.LongType()) for c in names]
    kept = [T.StructField(f.name, f.dataType) for f in docs.schema.fields if not (digest and f.name == "text")]
    packed = [T.StructField(own[c], T.BinaryType()) for c in ("segs", "sizes", "links")]
    schema = T.StructType([*kept, *longs(COUNTS), T.StructField(text, T.StringType()), *longs([own["unit"]]), *packed, T.StructField(own["pairs"], T.ArrayType(PAIR))])
    shared = spark.sparkContext.broadcast(tokenizers or load())
    rows = scratch.table(docs.mapInArrow(_read(shared, digest, own, to_arrow_schema(schema)), schema), "aligned")
    found = rows.select(F.col(own["unit"]).alias("unit"), F.posexplode(own["pairs"]).alias("pos", "pair")).select("unit", "pos", "pair.*")
    counts = scratch.table(found.groupBy("a_id", "b_id").agg(F.sum("n").alias("n")), "pairs")
    ranked = counts.withColumn("top", F.max("n").over(Window.partitionBy("b_id")))  # a B id meets A's vocabulary at most
    counted = found.drop("n").join(ranked, ["a_id", "b_id"]).select("unit", "pos", "n", "top")
    out = T.StructType([*kept, *longs(OWN), T.StructField(text, T.StringType())])
    both = rows.drop(own["pairs"]).groupBy(own["unit"]).cogroup(counted.groupBy("unit"))  # a slice and its pairs
    return both.applyInArrow(_valued(own, to_arrow_schema(out)), out), counts


def op12(spark, sf_dir):
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)[0]
