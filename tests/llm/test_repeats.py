"""Suffix-array and FM-index dedup against brute force."""

import random
import re

import pytest

from kamishi.llm.fm_dedup import dedup_substrings
from kamishi.llm.suffix_dedup import dedup_suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, alphabet, sep, n=40):
    r = random.Random(seed)
    passages = [sep.join(r.choice(alphabet) for _ in range(r.randint(6, 40))) for _ in range(6)]
    docs = [None, "", sep, alphabet[0] * 3]
    for _ in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else sep.join(r.choice(alphabet) for _ in range(r.randint(1, 25))) for _ in range(r.randint(1, 5))]
        docs.append(sep.join(parts))
    docs += [docs[7], docs[7], docs[9] + sep + docs[9], sep.join([alphabet[0]] * 60)]
    ids = list(range(len(docs)))
    r.shuffle(ids)
    return list(zip(ids, docs, strict=True))


def brute(rows, window, split, smaller):
    units = [(d, split(t or "")) for d, t in rows]
    seen = {}
    for n, (d, u) in enumerate(units):
        for i in range(len(u) - window + 1):
            seen.setdefault(tuple(u[i : i + window]), []).append(d if smaller else (n, i))
    out = {}
    for d, u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            hits = seen[tuple(u[i : i + window])]
            if (min(hits) < d) if smaller else (len(hits) > 1):
                gone[i : i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.setdefault(d, []).append((len(u), sum(gone), spans, [x for x, g in zip(u, gone, strict=True) if not g]))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed, hot):
    rows = corpus(seed, list("abcdé"), "")
    done = dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string"), 8, 3, hot).collect()
    want = brute(rows, 8, lambda t: list(t.encode()), False)
    assert len(done) == len(rows)
    for r in done:
        assert (r.n_units, r.n_removed, r.n_spans, list(r.kept)) == want[r.doc_id][0], r


@pytest.mark.parametrize("hot", [4096, 2])
@pytest.mark.parametrize("seed", [3, 4])
def test_words(spark, seed, hot):
    rows = corpus(seed, ["ab", "c", "dé", "e", "fgh"], " ")
    done = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 6, 2, hot).collect()
    want = brute(rows, 6, WORD.findall, True)
    assert len(done) == len(rows)
    for r in done:
        n, gone, spans, kept = want[r.doc_id][0]
        assert (r.n_units, r.n_removed, r.n_spans, r.kept.decode()) == (n, gone, spans, " ".join(kept)), r


def test_edges(spark):
    schema = "doc_id long, text string, kept_before int, kept string"
    empty = spark.createDataFrame([], schema)
    assert dedup_suffixes(empty).count() == dedup_substrings(empty).count() == 0
    rows = [(None, "a b c d e f g", 1, "k"), (5, "a b c d e f g", 2, None), (5, "a b c d e f g", 2, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((str(r.doc_id), r.n_removed, r.kept_before) for r in dedup_substrings(df, 5, 2).collect())
    assert got == [("5", 0, 2), ("5", 0, 2), ("None", 0, None), ("None", 7, 1)]
    assert sorted(r.n_removed for r in dedup_suffixes(df, 5, 2).collect()) == [0, 13, 13, 13]


def test_more_tasks_than_shuffle_partitions(spark, monkeypatch):
    """A corpus too large for the session's shuffle partitions is dealt into more of them, with the same answer."""
    from kamishi.llm import anchored

    monkeypatch.setattr(anchored, "TASK_BYTES", 400)
    rows = corpus(6, list("abcdé"), "")
    want = brute(rows, 8, lambda t: list(t.encode()), False)
    for r in dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string"), 8, 3).collect():
        assert (r.n_units, r.n_removed, r.n_spans, list(r.kept)) == want[r.doc_id][0], r
