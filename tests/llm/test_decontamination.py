"""Decontamination against plain loops over windows; the automaton against all substrings; edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kamishi.llm import bytesvec as bv
from kamishi.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, items int, spans string, kept string, item string"
FOUND = ("n_words", "n_hit", "items")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def windows(items, size):
    out = {}
    for i, text in items:
        w = WORD.findall(low(text))
        for k in range(len(w) - size + 1) if len(w) >= size else range(bool(w)):
            out.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    return out


def brute(rows, items, size):
    wanted = windows(items, size)
    out = []
    for i, text, *_ in rows:
        spots = [m.span() for m in WORD.finditer(low(text))]
        w = WORD.findall(low(text))
        hit, found = set(), set()
        for n in {len(g) for g in wanted}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wanted:
                    hit |= set(range(k, k + n))
                    found |= wanted[tuple(w[k : k + n])]
        clean, k = text, len(w) - 1
        while k >= 0:
            if k in hit:
                end = k
                while k - 1 in hit:
                    k -= 1
                clean = clean[: spots[k][0]] + clean[spots[end][1] :]
            k -= 1
        out.append((i, len(w), len(hit), sorted(found), clean))
    return out


def got(spark, rows, items, size, **options):
    docs = spark.createDataFrame([(i, t, 4, "s", "k", "i") for i, t in rows], DOCS)
    done = dc.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), size, **options)
    return [(r.doc_id, r.n_words, r.n_hit, r["items"], r.clean_text) for r in done.collect()]


def key(rows):
    return sorted(((r[0] is None, r[0] or 0, r[4] or "", r[4] is None), r) for r in rows)


def corpus(seed):
    """Documents that hold parts of items, over few words so that much is shared."""
    r = random.Random(seed)
    alphabet = ["a", "Bb", "été", "9", "中文", "x-y", "zz"]
    text = lambda n: " ".join(r.choice(alphabet) for _ in range(n))
    items = [(r.choice([k, k, None]), text(r.choice([0, 2, 3, 4, 5, 9, 30]))) for k in range(25)] + [(7, None), (8, " .,"), (9, "ONLY")]
    rows = [(k, text(r.choice([0, 1, 3, 10, 60]))) for k in range(60)]
    for k in range(60, 90):
        words = (r.choice(items)[1] or "").split()
        at = r.randint(0, max(len(words) - 1, 0))
        rows.append((k, text(5) + "; " + " . ".join(words[at : at + 12]) + "! only " + text(3)))
    return rows + [(None, "a Bb a"), (None, "a Bb a"), (3, rows[70][1]), (3, rows[70][1]), (200, None), (201, ""), (202, "\n")], items


@pytest.mark.parametrize("size", [1, 3, 5, 10])
def test_against_brute_force(spark, size):
    rows, items = corpus(size)
    assert key(got(spark, rows, items, size)) == key(brute(rows, items, size))


def test_blocks_and_pieces_change_nothing(spark):
    rows, items = corpus(11)
    assert key(got(spark, rows, items, 4, block_words=40, piece_words=6)) == key(brute(rows, items, 4))


def test_long_runs_are_cut(spark):
    """A document that repeats an item for longer than a chunk, and one beyond a slice of bytes."""
    item = " ".join(f"w{k}" for k in range(3000))
    rows = [(1, item), (2, item.replace("w1500 ", "other ")), (3, "free " * 10 + item[:9000]), (4, "some other words " * 600_000 + item[-200:])]
    items = [(5, item), (6, "w2 w3 w4")]
    found = {r[0]: r[1:4] for r in got(spark, rows, items, 10)}
    assert found[1] == (3000, 3000, ["5", "6"]) and found[2] == (3000, 2999, ["5", "6"])
    words = item[-200:].count(" ") + 1
    assert found[4] == (1_800_000 + words, words - 1, ["5"])  # its first word is the tail of one of the item's
    assert key(got(spark, rows[2:3], items, 10)) == key(brute(rows[2:3], items, 10))


def test_share_and_spans(spark):
    docs = spark.createDataFrame([(1, "one TWO three. four!"), (2, "a b c d e f g one two")], "doc_id long, text string")
    done = dc.decontaminate(docs, spark.createDataFrame([(1, "one two"), (2, "Three")], "item_id long, text string"), 2, max_share=0.5).orderBy("doc_id").collect()
    assert [(r.kept, r.contaminated, r.clean_text) for r in done] == [(False, True, ". four!"), (True, True, "a b c d e f g ")]
    assert [tuple(s) for s in done[0].spans] == [(0, 3, 0, 13)]


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(1, "a b c"), (2, None)]
    assert key(got(spark, rows, [], 3)) == key([(1, 3, 0, [], "a b c"), (2, 0, 0, [], None)])
    assert dc.decontaminate(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_longest_matches():
    """At every word the longest suffix that is somewhere in an item."""
    r = random.Random(2)
    items = [(str(k), [r.choice("abc") for _ in range(r.randint(1, 12))]) for k in range(12)]
    a = dc.build(items, 4)
    whole = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    text = [r.choice("abc") for _ in range(300)]
    buf, offs = bv.buffer_of(pa.array([" ".join(text)]))
    starts, ends, _ = bv.word_spans(buf, offs, dc.NO_WORD)
    words = a.words(bv.word_hashes(buf, starts, ends))
    at, _, match = dc.longest_matches(a, words, np.array([0]), np.array([len(words)]))
    for k, n in zip(at.tolist(), match.tolist(), strict=True):
        assert n == max(n for n in range(1, 13) if tuple(text[max(0, k + 1 - n) : k + 1]) in whole and n <= k + 1)


def test_hash_collisions_are_no_hits():
    """A word that shares an item word's hash is not that word."""
    a = dc.build([("1", ["aa", "bb", "cc"])], 3)
    text = b"aa bb cc aa bx cc"
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = bv.word_spans(buf, np.array([0, len(text)]), dc.NO_WORD)
    words = a.words(bv.word_hashes(buf, starts, ends))
    words[4] = words[1]
    last = np.arange(6) == 5
    found = dc.find_windows(a, words, last)
    assert found[0].tolist() == [2, 5] and dc._verified(a, buf, starts, ends, words, *found)[0].tolist() == [2]
