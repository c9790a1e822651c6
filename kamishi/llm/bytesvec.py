"""Whole Arrow batches of texts as one byte buffer: words, prefix hashes and minimizers by numpy.

Hashes are polynomials modulo 2**64 over random byte values; a span's hash is a difference of two
prefix sums times a power of the inverse base. Spans are compared through mixed hashes of short
grams, so that no long structured text makes two different spans collide.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def release() -> None:
    """Give freed memory back to the system: workers are kept between tasks, and so is what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def powers(n: int, kind: str = "base") -> np.ndarray:
    """BASE**0 .. BASE**(n-1), or of its inverse; grown as needed and kept."""
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 16), BASE if kind == "base" else INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offs, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8, int(o[-1] - o[0]), int(o[0])) if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    return raw, o - o[0]


def slices(column, size: int):
    """(first, end) of runs of rows with about size bytes of text, one row at least."""
    lens = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lens) // size
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))).tolist() if len(lens) else []
    return zip(cut, [*cut[1:], len(lens)], strict=False)


def word_spans(buf: np.ndarray, offs: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (a run of bytes that is_space excludes), and word offsets of each text."""
    word = ~is_space[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])) | word & cut[:-1]) if len(buf) else np.empty(0, np.int64)
    ends = np.flatnonzero(word & (np.concatenate((~word[1:], [True])) | cut[1:])) + 1 if len(buf) else np.empty(0, np.int64)
    return starts, ends, np.searchsorted(starts, offs)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free polynomial hash of values[starts:ends]; not mixed."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix), "inverse")[starts]


def byte_prefix(buf: np.ndarray) -> np.ndarray:
    return prefix_sums(_BYTES[buf])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hash(byte_prefix(buf), starts, ends))


def _rounds(starts: np.ndarray, ends: np.ndarray, size: int):
    """(first, end) of runs of spans, in order of place, that cover about size bytes, one span at least."""
    part = starts // size
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(starts) else []
    return zip(cut, [*cut[1:], len(starts)], strict=False)


def alike(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(first of each distinct span, which of them each span equals) of spans in order of place: spans meet
    by hash and are compared, some size bytes at a time. If two different ones share a hash, every span
    stands for itself."""
    hashes = np.empty(len(starts), np.uint64)
    for lo, hi in _rounds(starts, ends, size):
        at = starts[lo]
        hashes[lo:hi] = word_hashes(buf[at : ends[hi - 1]], starts[lo:hi] - at, ends[lo:hi] - at)
    _, first, same = np.unique(hashes, return_index=True, return_inverse=True)
    lens, shift = ends - starts, starts[first][same] - starts
    equal = (lens == lens[first][same]).all()
    for lo, hi in _rounds(starts, ends, size) if equal else ():
        n = lens[lo:hi]
        at = np.arange(n.sum()) + np.repeat(starts[lo:hi] - np.cumsum(n) + n, n)
        equal = equal and (buf[at + np.repeat(shift[lo:hi], n)] == buf[at]).all()
    return (first, same) if equal else (np.arange(len(starts)), np.arange(len(starts)))


def gram_hashes(units: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of the k units that start at each unit; NONE where they leave the text."""
    n = len(units)
    out = np.full(n, NONE, np.uint64)
    if n >= k:
        values = _BYTES[units] if units.dtype == np.uint8 else units
        p = prefix_sums(values)
        at = np.arange(n - k + 1)
        out[: n - k + 1] = np.minimum(mix(span_hash(p, at, at + k)), NONE - np.uint64(1))
        last = np.repeat(offs[1:], np.diff(offs))[: n - k + 1]
        out[: n - k + 1][at + k > last] = NONE
    return out


def _sliding(op, values: np.ndarray, w: int) -> np.ndarray:
    """op over values[i:i+w] for every i that has w values, by doubling."""
    have, out = 1, values
    while have * 2 <= w:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = op(out[: len(values) - w + 1], out[w - have :][: len(values) - w + 1])
    return out


def minimizers(grams: np.ndarray, offs: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (gram positions) with the first and last start of the windows that they stand for.

    A window is `window` consecutive units of one text; its anchors are all positions of its least
    gram. Equal windows therefore have equal anchors at equal offsets, wherever they stand.
    """
    w = window - k + 1
    n = len(grams)
    none = np.empty(0, np.int64)
    if n < w:
        return none, none, none
    least = _sliding(np.minimum, grams, w)
    ends = np.repeat(offs[1:], np.diff(offs))
    inside = np.arange(len(least)) + window <= ends[: len(least)]
    least = np.where(inside, least, np.uint64(0))
    padded = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(n - len(least), np.uint64)))
    best = _sliding(np.maximum, padded, w)
    anchors = np.flatnonzero((best == grams) & (grams != NONE))
    firsts, lasts = np.empty_like(anchors), np.empty_like(anchors)
    starts = np.repeat(offs[:-1], np.diff(offs))
    wide = np.concatenate((np.zeros(w - 1, np.uint64), grams, np.zeros(w - 1, np.uint64)))
    view = np.lib.stride_tricks.sliding_window_view(wide, 2 * w - 1) if n else None
    step = max(1, (1 << 22) // (2 * w))
    for a in range(0, len(anchors), step):
        j = anchors[a : a + step]
        smaller = view[j] < grams[j][:, None]
        left = np.argmax(smaller[:, w - 2 :: -1] if w > 1 else smaller[:, :0], axis=1) if w > 1 else np.zeros(len(j), np.int64)
        left = np.where(smaller[:, : w - 1].any(axis=1), left, w - 1)
        right = np.where(smaller[:, w:].any(axis=1), np.argmax(smaller[:, w:], axis=1) if w > 1 else 0, w - 1)
        firsts[a : a + step] = np.maximum(j - left, starts[j])
        lasts[a : a + step] = np.minimum(np.minimum(j, j + right - w + 1), ends[j] - window)
    return anchors, firsts, lasts
