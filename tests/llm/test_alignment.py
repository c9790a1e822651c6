"""Alignment against plain loops over whole texts as both libraries encode them; edge cases."""

import hashlib
import random
from collections import Counter

import pytest

from kamishi.llm import alignment as al

DOCS = "doc_id long, text string, n_a string, unit int, segs string, groups int"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(al.BYTE_FILE)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=al.PIECE_FILE)


def spelled(libraries):
    a, b = libraries
    byte = {}
    for i in range(256):  # an entry of one character stands for one byte: printable ones for themselves
        byte[chr(i) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174 else chr(256 + len([j for j in range(i) if not (33 <= j <= 126 or 161 <= j <= 172 or j >= 174)]))] = i
    return lambda t: bytes(byte[c] for c in a.id_to_token(t)), lambda t: bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode()


def brute(libraries, rows):
    a, b = libraries
    bytes_of = spelled(libraries)
    aligned, counts = [], Counter()
    for _, text in rows:
        ids = ([], []) if not text else (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
        if text and any(b"".join(map(f, own)) != (" " + text).encode() for f, own in zip(bytes_of, ids, strict=True)):
            ids = ([], [])
        spans = []
        for f, own in zip(bytes_of, ids, strict=True):
            at, out = 0, []
            for t in own:
                out.append((at, at + len(f(t)), t))
                at = out[-1][1]
            spans.append(out)
        x, y = spans
        links, k = [], 0
        for lo, hi, t in x:
            while k < len(y) and y[k][1] <= lo:
                k += 1
            m = k
            while m < len(y) and y[m][0] < hi:
                links.append((t, y[m][2]))
                m += 1
        common = sorted({s[1] for s in x} & {s[1] for s in y})
        groups = [([], []) for _ in common]
        for side, own in enumerate(spans):
            g = 0
            for _, hi, t in own:
                groups[g][side].append(str(t))
                g += hi == common[g]
        aligned.append((x, y, groups, links))
        counts.update(links)
    top = Counter()
    for (_, t), n in counts.items():
        top[t] = max(top[t], n)
    return [
        (i, len(x), len(y), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), ";".join(",".join(g) + "|" + ",".join(h) for g, h in groups))
        for (i, _), (x, y, groups, links) in zip(rows, aligned, strict=True)
    ], counts


def got(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "x", 5, "y", 6) for i, t in rows], DOCS).repartition(parts)
    done, pairs = al.align(docs)
    assert done.columns == ["doc_id", "text", "unit", "segs", *al.OWN, "groups"]
    return done.collect(), Counter({(r.a_id, r.b_id): r.n for r in pairs.collect()})


def key(rows):
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in rows)


ODD = [
    None, "", " ", "  ", "a", "a ", "a  ", "  a", " a  b   c ", "a\n b\t c\r\n", "nbsp\xa0 x\xa0  y", "ideographic　 a  b  c\x85 d", "\x1c a\x1d  b",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "mark ▁ and▁ ▁▁ more", "日本語 と ｶﾅ １２３", "naïve façade Ünïcödé 🙂🙂 👩‍👩‍👧", "it's they'll 12345 we'd", "ﬁ ² ½ Å é", "x" * 500, "a\0b", "   \n\n  ", "\t", "end \n",
]


def test_against_brute_force(spark, libraries):
    r = random.Random(3)
    words = ["the", "Wissenschaft", "été", "à", "12", "foo_bar", "  ", "\n", "ñandú", "the", "la", "—", "“quoted”", "中文", "don't", "e" * 40, "…"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 40)))) for i in range(40)]
    rows += list(enumerate(ODD, 100)) + [(None, "the la"), (None, "the la"), (3, "the la"), (3, "the la"), (200, "long text here " * 20_000)]
    want, counts = brute(libraries, rows)
    found, pairs = got(spark, rows)
    assert key((x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups) for x in found) == key(want)
    assert pairs == counts


def test_digest_and_empty(spark, libraries):
    rows = [(1, "the Wissenschaft"), (2, None), (3, "▁")]
    want, _ = brute(libraries, rows)
    done, _ = al.align(spark.createDataFrame(rows, "doc_id long, text string"), digest=True)
    assert done.columns == ["doc_id", *al.OWN, "groups_sha256"]
    assert {x.doc_id: x.groups_sha256 for x in done.collect()} == {w[0]: hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want}
    assert al.align(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0
    assert [tuple(x) for x in al.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), digest=True)[0].collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_slices_and_rounds(spark, libraries, monkeypatch):
    """Small slices and rounds give the same: segments are cut anew in each, pairs are merged."""
    import pyarrow as pa

    rows = [(i, t or "") for i, t in enumerate(ODD)] * 2
    want, counts = brute(libraries, rows)
    import duckdb

    con, sides = duckdb.connect(), [al._opened(t) for t in al.load()]
    monkeypatch.setattr(al, "ROUND_BYTES", 16)
    merged = Counter()
    for lo in range(0, len(rows), 7):
        part = rows[lo : lo + 7]
        _, cols, groups, pairs, _ = al._aligned(con, sides, pa.array([t for _, t in part], pa.string()))
        assert [*zip(*(c.tolist() for c in cols), groups, strict=True)] == [(*w[1:5], w[-1]) for w in want[lo : lo + 7]]
        merged.update({(p["a_id"], p["b_id"]): p["n"] for p in pairs.to_pylist()})
    assert merged == counts


def test_packed_lists():
    import numpy as np

    values, at = np.array([0, 127, 128, 16383, 16384, 5, 1 << 21, (1 << 31) - 1]), np.array([0, 0, 3, 3, 7, 8])
    for lo in range(6):
        got = al.unpack(al.pack(values, at).slice(lo))
        assert got[0].tolist() == values[at[lo] :].tolist() and got[1].tolist() == (at[lo:] - at[lo]).tolist()
    assert al.unpack(al.pack(values[:0], np.array([0])))[0].tolist() == []
