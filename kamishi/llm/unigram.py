"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The best segmentation maximises the sum of the pieces' log scores. A unigram file brings them; a BPE
file has only merge ranks, which Zipf's law turns into logs of relative frequencies (nothing is
trained); a piece without a rank, like the longer marker runs, counts as the last one.
No piece crosses from text into a following white-space marker, so every word (a marker run with what
follows it) is segmented by itself, and a batch's distinct words all step through the trie together.
A character that is no piece becomes byte pieces, below any piece's score. Decoding joins the pieces,
turns markers into spaces and drops the one put in front.

Null text gives null ids; empty text gives none. Encoding then decoding returns every text unchanged
but one with U+2581, the marker itself, which decodes to a space (round_trip is false there). Texts
may be of any length; one that exceeds a slice is a slice of its own. Repeated rows get equal ids. An
empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesvec as bv
from .common import table

PIECE_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: How far a character as byte pieces lies below the file's least score.
BYTE_PENALTY = 10.0
CHUNK_BYTES = 4 << 20
WIDTH = 96  # words of more bytes step one by one


@dataclass(frozen=True)
class Trie:
    """base[s] + byte is the child's place; check says whose child it is; value its piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(keys: list[bytes]) -> Trie:
    """Double array over sorted keys, breadth first, each node's children at the first free base."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for i, key in enumerate(keys):
        node = 0
        for byte in key:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                values.append(-1)
            node = children[node][byte]
        values[node] = i
    size = len(children) * 2 + 512
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    place = {0: 0}
    queue, first, top = [0], 1, 1
    for node in queue:
        kids = sorted(children[node])
        at = place[node]
        value[at] = values[node]
        if not kids:
            base[at] = 0
            continue
        offsets = np.array(kids)
        if top + 512 >= len(free):
            grow = len(free)
            base, check, value = (np.concatenate((x, np.full(grow, fill, np.int32))) for x, fill in ((base, 0), (check, -1), (value, -1)))
            free = np.concatenate((free, np.ones(grow, bool)))
        late = max(first + 4096, top - 4096)
        holes = np.concatenate((np.flatnonzero(free[first : first + 4096]) + first, np.flatnonzero(free[late:top]) + late)) - kids[0]
        holes = holes[holes > 0]
        fits = free[np.minimum(holes[:, None] + offsets, len(free) - 1)].all(axis=1)
        b = int(holes[fits.argmax()]) if fits.any() else top + 1
        top = max(top, b + kids[-1])
        base[at] = b
        for byte in kids:
            child = children[node][byte]
            place[child] = b + byte
            free[b + byte] = False
            check[b + byte] = at
            queue.append(child)
        while not free[first]:
            first += 1
    used = int(np.flatnonzero(~free).max()) + 257
    return Trie(base[:used].copy(), check[:used].copy(), value[:used].copy())


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[bytes, ...]  # text that each id stands for, marker and all; bytes of byte pieces
    trie: Trie
    ids: np.ndarray  # id of each trie value
    scores: np.ndarray  # score of each trie value
    byte_id: np.ndarray
    byte_score: float  # score of a character as byte pieces


#: Scores below this mean that a piece has no rank.
UNRANKED = -1e6


def log_scores(scores: np.ndarray) -> np.ndarray:
    """Log scores of a file's scores: as they are, but where they are merge ranks (0, -1, -2, ...) the
    logs of relative frequencies by Zipf's law."""
    if not (scores == np.floor(scores)).all():
        return scores
    rank = np.where(scores > UNRANKED, -scores, len(scores) - 1)
    return -np.log(rank + 1) - np.log((1 / (rank + 1)).sum())


def load(path: str = PIECE_FILE) -> Vocabulary:
    """Read a piece file on the driver; what executors get is bounded by the vocabulary."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    pieces, keys, byte_id = [], {}, np.full(256, -1, np.int64)
    for i in range(n):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            byte_id[int(p[3:5], 16)] = i
            pieces.append(bytes([int(p[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i):
            pieces.append(b"")
        else:
            pieces.append(p.encode())
            keys[p.encode()] = i
    usable = sorted(k for k in keys if MARK not in k.decode().lstrip(MARK))
    ids = np.array([keys[k] for k in usable])
    scores = log_scores(np.array([m.get_score(int(i)) for i in ids]))
    return Vocabulary(tuple(pieces), build_trie(usable), ids, scores, byte_id, float(scores.min()) - BYTE_PENALTY)


def segment(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Best piece ids of each word, all words in step."""
    out: list[list[int]] = [[] for _ in words]
    by_length = sorted(range(len(words)), key=lambda i: len(words[i]))
    for lo in range(0, len(by_length), 1 << 15):
        part = by_length[lo : lo + (1 << 15)]
        while part and len(words[part[-1]]) > WIDTH:  # long words alone: their tables would be mostly padding
            i = part.pop()
            out[i] = _segment([words[i]], v)[0]
        if part:
            for i, ids in zip(part, _segment([words[i] for i in part], v), strict=True):
                out[i] = ids
    return out


def _segment(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    n, longest = len(words), max(map(len, words))
    lens = np.array([len(w) for w in words])
    text = np.zeros((longest, n), np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    col = np.repeat(np.arange(n), lens)
    row = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    text[row, col] = flat
    score = np.full((longest + 1, n), -np.inf)
    score[0] = 0
    piece = np.full((longest + 1, n), -1, np.int64)  # trie value that ends here; -2: byte pieces
    came = np.zeros((longest + 1, n), np.int64)
    end, single = np.zeros(n, np.int64), np.zeros(n, bool)
    t = v.trie
    for s in range(longest):
        live = np.flatnonzero((lens > s) & np.isfinite(score[s]))
        if not len(live):
            continue
        lead = text[s, live]
        end[live] = np.minimum(s + np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))), lens[live])
        single[:] = False  # whether the character that starts here is a piece
        state, own, at = np.zeros(len(live), np.int64), live, s
        while True:
            to = t.base[state] + text[at, own]
            ok = t.check[to] == state
            state, own = to[ok], own[ok]
            at += 1
            if not len(own):
                break
            ends = t.value[state]
            hit = ends >= 0
            who, which = own[hit], ends[hit]
            if at <= s + 4:
                single[who[end[who] == at]] = True
            total = score[s, who] + v.scores[which]
            better = total > score[at, who]
            who = who[better]
            score[at, who], piece[at, who], came[at, who] = total[better], which[better], s
            on = lens[own] > at
            state, own = state[on], own[on]
            if not len(own):
                break
        bare = live[~single[live]]
        if len(bare):
            worse, to = score[s, bare] + v.byte_score, end[bare]
            better = worse > score[to, bare]
            bare, to = bare[better], to[better]
            score[to, bare], piece[to, bare], came[to, bare] = worse[better], -2, s
    out: list[list[int]] = [[] for _ in words]
    at, live = lens.copy(), np.arange(n)[lens > 0]
    steps = []
    while len(live):
        p, c = piece[at[live], live], came[at[live], live]
        steps.append((live, p, c, at[live].copy()))
        at[live] = c
        live = live[c > 0]
    for who, p, c, e in reversed(steps):
        for w, k, a, b in zip(who.tolist(), p.tolist(), c.tolist(), e.tolist(), strict=True):
            out[w].extend([int(v.ids[k])] if k >= 0 else [int(v.byte_id[x]) for x in words[w][a:b]])
    return out


_MARK = np.frombuffer(MARK.encode(), np.uint8)


def _marked(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, starts of words) of texts with markers for spaces and one put in front of each
    that is not empty; a word is a run of markers with what follows it."""
    texts = pc.fill_null(texts, "")
    front = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", MARK)
    buf, offs = bv.buffer_of(pc.binary_join_element_wise(front, pc.replace_substring(texts, " ", MARK), ""))
    at = np.zeros(len(buf) + 3, bool)
    if len(buf) > 2:
        at[3:-2] = (buf[:-2] == _MARK[0]) & (buf[1:-1] == _MARK[1]) & (buf[2:] == _MARK[2])
    opens = np.zeros(len(buf) + 1, bool)
    opens[offs] = True
    return buf, offs, np.flatnonzero(at[3:] & (~at[:-3] | opens[:-1]))


def encode_slice(texts, v: Vocabulary, known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of an array of texts; known keeps words for later slices.

    Words meet by a 64-bit hash, and each is compared with the one that stands for it.
    """
    buf, offs, starts = _marked(texts)
    if not len(starts):
        return np.empty(0, np.int32), np.zeros(len(offs), np.int64)
    ends = np.append(starts[1:], len(buf))
    _, first, word = np.unique(bv.word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    shift = starts[first][word] - starts
    lens = ends - starts
    alike = (lens == lens[first][word]).all() and (buf[np.minimum(np.arange(len(buf)) + np.repeat(shift, lens), len(buf) - 1)] == buf).all()
    if not alike:  # a collision: every word stands for itself
        first = word = np.arange(len(starts))
    raw = buf.tobytes()
    distinct = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    new = list({w for w in distinct if w not in known})
    known.update((w, np.array(ids, np.int32)) for w, ids in zip(new, segment(new, v), strict=True))
    held = [known[w] for w in distinct]
    size = np.array([len(x) for x in held])
    begin, n = (np.cumsum(size) - size)[word], size[word]
    at = np.concatenate(([0], np.cumsum(n)))
    ids = np.concatenate(held)[np.arange(at[-1]) + np.repeat(begin - at[:-1], n)]
    return ids, at[np.searchsorted(starts, offs)]


def encode_batch(texts: list[str | None], v: Vocabulary) -> list[list[int] | None]:
    ids, at = encode_slice(pa.array(texts, pa.string()), v, {})
    return [None if t is None else ids[x:y].tolist() for t, x, y in zip(texts, at[:-1], at[1:], strict=True)]


def decode(ids, v: Vocabulary) -> str:
    text = b"".join([v.pieces[i] for i in np.asarray(ids).tolist()]).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


#: Distinct words whose segmentation a task keeps.
KNOWN_WORDS = 200_000


def _slices(column):
    lens = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lens) // CHUNK_BYTES
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(lens) else np.empty(0, np.int64)
    return zip(cut.tolist(), [*cut[1:].tolist(), len(lens)], strict=True) if len(lens) else ()


def _encoded(shared, digest):
    def run(batches):
        v, known = shared.value, {}
        is_byte = np.zeros(len(v.pieces), bool)
        is_byte[v.byte_id] = True
        for batch in batches:
            for lo, hi in _slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                if len(known) > KNOWN_WORDS:
                    known.clear()
                text = part.column("text")
                ids, at = encode_slice(text, v, known)
                if digest:
                    own = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    n_bytes = np.concatenate(([0], np.cumsum(is_byte[ids])))
                    back = (decode(i, v) for i in own)
                    cols = [
                        pa.array(np.diff(at)), pa.array(np.diff(n_bytes[at])), pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in own]),
                        pa.array([t is None or b == t for t, b in zip(text.to_pylist(), back, strict=True)], pa.bool_()),
                    ]
                    names = ["n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"]
                else:
                    cols, names = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=text.is_null())], ["ids"]
                keep = [c for c in part.schema.names if not (digest and c == "text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], [*keep, *names])

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs with ids, the pieces of text (a column of that name is replaced)."""
    docs = docs.drop("ids")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.mapInArrow(_encoded(shared, False), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def encode_digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (of little-endian int32) and whether decoding returns the text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select("doc_id", "text").mapInArrow(_encoded(shared, True), "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")


def _decoded(shared):
    def run(batches):
        for batch in batches:
            texts = [None if i is None else decode(i, shared.value) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """encoded with decoded, the text that its ids stand for (a column of that name is replaced)."""
    encoded = encoded.drop("decoded")
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    return encoded.mapInArrow(_decoded(shared), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def op2(spark, sf_dir):
    return encode_digest(table(spark, sf_dir, "documents"), load())
