"""SentencePiece encoding against a Viterbi over the whole text and the full vocabulary."""

import hashlib
import math
import random
import struct

import pytest
import sentencepiece

from kamishi.llm import unigram

TEXTS = [
    "1", "2024-11-05", "a 1 b 22", "a  b", "   z", "x\n  y", "a" + " " * 18 + "b", " " * 5, "ñ", "El niño añade ñandú", "ß øre ç 日 日本", "\r\r \x0b\x0c",
    "😀 ok 😀1", "▁▁ x", "3  ñ  5",
]


@pytest.fixture(scope="module")
def file():
    m = sentencepiece.SentencePieceProcessor(model_file=unigram.PIECE_FILE)
    normal = {m.id_to_piece(i): i for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    return m, normal


def zipf(m, normal):
    """Log of each piece's relative frequency by its rank; pieces without a rank come last."""
    rank = {i: -m.get_score(i) if m.get_score(i) > -1e6 else len(normal) - 1 for i in normal.values()}
    total = math.log(sum(1 / (r + 1) for r in rank.values()))
    return {i: -math.log(r + 1) - total for i, r in rank.items()}


def brute(text, m, normal, score_of):
    """(best total, byte pieces, ids) over all segmentations; characters that are no piece as bytes."""
    s = "▁" + text.replace(" ", "▁")
    bare = min(score_of.values()) - 10
    best = [(0.0, 0, [])] + [None] * len(s)
    for i in range(len(s)):
        ways = [(score_of[normal[s[i:j]]], 0, [normal[s[i:j]]], j) for j in range(i + 1, min(i + 17, len(s)) + 1) if s[i:j] in normal]
        if s[i] not in normal:
            b = s[i].encode()
            ways.append((bare, len(b), [m.piece_to_id(f"<0x{x:02X}>") for x in b], i + 1))
        for score, n, ids, j in ways:
            if best[j] is None or best[i][0] + score > best[j][0]:
                best[j] = (best[i][0] + score, best[i][1] + n, best[i][2] + ids)
    return best[-1]


def test_whole_vocabulary(file):
    m, normal = file
    v, score_of = unigram.load(), zipf(m, normal)
    r = random.Random(4)
    words = ["12", "7", "ñu", "niño", "the", "tokenizer", "Größe", "ça", "日本", "x1", "😀", "", "", "def", "\n", "\t"]
    texts = TEXTS + [" ".join(r.choice(words) for _ in range(30)) for _ in range(40)]
    letters = "etaoin shrdlu  ñçßéèüøđ漢字かなкот😀🎉①\n\t0123456789.,-▁"
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(1000)]
    texts += ["x" * 300, "pneumono" * 40, " " * 200 + "ok"]
    for text, ids in zip(texts, unigram.encode_batch(texts, v), strict=True):
        total, n_bytes, want = brute(text, m, normal, score_of)
        assert ids == want, text
        assert unigram.decode(ids, v) == text.replace("▁", " ")
        assert sum(m.is_byte(i) for i in ids) == n_bytes
    assert unigram.encode_batch(["1", "ñ", "a  b", "   z"], v) == [[28705, 28740], [28705, 28877], [264, 28705, 287], [2287, 686]]


def test_whole_words_before_early_merges(file):
    m, _ = file
    v = unigram.load()
    pieces = lambda t: [m.id_to_piece(i) for i in unigram.encode_batch([t], v)[0]]
    assert pieces("The tokenizer") == ["▁The", "▁token", "izer"]
    assert pieces("The government of the people") == ["▁The", "▁government", "▁of", "▁the", "▁people"]


def test_digest(spark, file):
    """Null, empty, repeated and marked texts, with clashing and further columns; whole lists and digests agree."""
    m, normal = file
    v, schema = unigram.load(), "doc_id long, ids string, text string, n_tokens int"
    rows = [(1, "x", "a  b c", 1), (2, None, None, 2), (3, "y", "", 3), (1, "x", "a  b c", 1), (None, "z", "▁ x", 4), (5, "", "1 ñ 日本 \ufffd", 5)]
    docs = spark.createDataFrame(rows, schema)
    done = {(r.doc_id, r.n_tokens): r for r in unigram.encode_digest(docs, v).collect()}
    lists = unigram.decode_ids(unigram.encode(docs, v), v).collect()
    assert [r.n_tokens for r in lists] == [x[3] for x in rows] and lists[0].ids == lists[3].ids
    assert [r.decoded for r in lists] == ["a  b c", None, "", "a  b c", "  x", rows[5][2]]
    for r in lists:
        ids = r.ids or []
        got = done[r.doc_id, len(ids)]
        assert got.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}i", *ids)).hexdigest()
        assert got.round_trip == ("▁" not in (r.text or "")) and got.n_byte_tokens == sum(m.is_byte(i) for i in ids)
    assert unigram.encode_digest(spark.createDataFrame([], schema), v).count() == 0


def test_every_piece_is_in_the_trie(file):
    _, normal = file
    assert set(unigram.load().ids.tolist()) == set(normal.values())
    assert {c for p in normal for c in p} <= set(normal)  # so only characters that no piece covers become bytes
