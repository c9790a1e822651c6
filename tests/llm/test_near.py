"""Near-dedup against brute force."""

import random
import re

import numpy as np
import pytest

from kamishi.llm import near_dedup
from kamishi.llm.near_dedup import _common, estimates, near_duplicates, needed_runs, one_of_each, shared_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size):
    sets = [shingle_set(t, size) for _, t in rows]
    comp = {d: d for d, _ in rows}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, s = sorted((root(a), root(rows[j][0])))
                comp[s] = r
    return {d: (len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True)}


def chain_corpus(seed):
    """Families whose members drift apart step by step, so that links run through chains."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randint(0, 400))
    docs = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    for _ in range(5):
        text = [word() for _ in range(r.randint(8, 50))]
        for _ in range(25):
            text = list(text)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = word()
            docs.append(" ".join(text))
    docs += [docs[9], docs[9].upper(), docs[40]]
    ids = list(range(100, 100 + len(docs)))
    r.shuffle(ids)
    return list(zip(ids, docs, strict=True))


@pytest.mark.parametrize(("size", "block"), [(2, 512), (5, 3)])
def test_components(spark, size, block):
    rows = chain_corpus(size + block)
    done = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, block=block).collect()
    want = brute(rows, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in done} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in done)


def test_edges(spark):
    schema = "doc_id long, text string, comp int, node string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", 1, "x"), (7, "a b c", 1, None), (7, "a b c", 1, None), (3, None, 2, "y")]
    got = sorted(map(str, near_duplicates(spark.createDataFrame(rows, schema)).collect()))
    assert len(got) == 4 and sum("component_id=7, kept=False" in g for g in got) == 1 and sum("doc_id=7, n_shingles=2, component_id=7, kept=True" in g for g in got) == 2


def test_group_helpers():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 30)) for _ in range(9)]
    owner, values = np.repeat(np.arange(9), [len(s) for s in sets]), np.concatenate(sets)
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    shared = _common(owner, values, 9)
    assert all(shared[i, j] == want[i][j] for i in range(9) for j in range(9) if i != j)
    pad = np.full((9, 64), 2**63 - 1)
    for i, s in enumerate(sets):
        pad[i, : len(s)] = s
    est = estimates(pad[:1].repeat(9, 0), pad, np.zeros(9, bool), 64)
    for j, b in enumerate(sets):
        assert abs(est[j] - want[0][j] / len(np.union1d(sets[0], b))) < 1e-12
    wide = np.array([np.arange(64), np.append(np.arange(0, 126, 2), 200)])
    assert estimates(wide[:1], wide[1:], np.array([True]), 64)[0] == 32 / 96
    assert abs(estimates(wide[:1], wide[1:], np.array([False]), 64)[0] - 32 / 64) < 1e-12


def test_needed_runs(spark):
    """Whole sets at the threshold share as many runs as is said, wherever the differing values lie."""
    from pyspark.sql import functions as F

    assert shared_runs(64, (80, 100)) == 10
    need = {r.n: r.need for r in spark.range(1, 200).select(F.col("id").alias("n"), needed_runs(F.col("id"), 64, (80, 100)).alias("need")).collect()}
    r = random.Random(3)
    for _ in range(3000):
        union = r.randint(5, 20)
        lacking = set(r.sample(range(union), union // 5))
        both = [i not in lacking for i in range(union)]
        runs = sum(x and y for x, y in zip(both, both[1:]))
        assert all(need[n] <= runs for n in range(union - len(lacking), union + 1)) and runs >= 1
    assert need[200 - 1] == 10


def test_family_around_a_missing_centre(spark):
    """Members close to a text that is not there: many small components, compared exactly."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(120):
        text = list(base)
        for i in r.sample(range(150), r.randint(6, 16)):
            text[i] = f"x{r.randint(0, 30)}"
        rows.append((d, " ".join(text)))
    rows += [(200 + d, " ".join([*base[:40], *[f"y{d}-{i}" for i in range(r.randint(0, 120))]])) for d in range(60)]
    done = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in done} == brute(rows, 2)


def test_rows_whose_names_meet(spark, monkeypatch):
    """Different rows of one name are rows of their own, by either join; equal rows stay one node."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_dedup, "row_name", lambda: F.pmod(F.xxhash64("text", F.col("doc_id").cast("long")), F.lit(7)))
    rows = chain_corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == want
    monkeypatch.setattr(near_dedup, "SMALL", 0)
    left = sorted(r.doc_id for r in one_of_each(docs.unionByName(docs)).collect())
    blank = [d for d, (n, _) in want.items() if n == 0]  # linked with nothing, so their equal rows stay
    assert left == sorted([*{c for _, c in want.values()}, *blank])


def test_without_loss(spark):
    """A pair that lacks the runs asked for is lost by the bound, and found with loss=None."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    other = list(base)
    for i in r.sample(range(200), 9):
        other[i] = "x" + other[i]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, "a b c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shared_runs(64, (80, 100), None) == 1 and brute(rows, 2)[2][1] == 1
    found = lambda loss: {x.doc_id: x.component_id for x in near_duplicates(docs, slack=None, loss=loss).collect()}
    assert found(None) == {1: 1, 2: 1, 3: 3}
    assert found(1 - 1e-15) == {1: 1, 2: 2, 3: 3}
