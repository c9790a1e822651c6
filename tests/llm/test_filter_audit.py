"""The audit against every document walked through every order; edge cases."""

import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from kamishi.llm import filter_audit as fa

DOCS = "doc_id long, text string, source string, part int, mask string, n long"
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = []
    for i, t, source, *_ in rows:
        t, w = t or "", WORD.findall(t or "")
        failed.append((i, source or "", {
            n for n, bad in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)),
                             ("D", bool(re.search(r"[#$%&*|]", t))), ("E", i is not None and texts[t] < i)) if bad}))
    out = {}
    for part in {p for _, p, _ in failed}:
        credit = Counter()
        for order in permutations("ABCDE"):
            for k, own in enumerate(order):
                c = Counter(kept=0)
                for i, p, bad in failed:
                    if p == part:
                        gone = bool(bad & set(order[:k]))
                        removed = own in bad and not gone
                        c.update(kept=not gone and own not in bad, removed=removed, redundant=own in bad and gone, unique=bad == {own}, good=removed and i in good, toxic=removed and i in toxic)
                credit[own] += c["removed"]
                out[part, "".join(order), k + 1] = [c[x] for x in ("kept", "removed", "redundant", "unique", "good", "toxic")]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(credit[order[k - 1]])
    return out


def got(spark, rows, labels, **options):
    docs = spark.createDataFrame([(*r, 7, "m", 3) for r in rows], DOCS)
    found = fa.audit(docs, spark.createDataFrame(labels, LABELS), **options).collect()
    assert len(found) == len({(r.part, r.filter_order, r.step) for r in found})
    return {(r.part, r.filter_order, r.step): list(r[3:]) for r in found}


def test_against_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "Bc", "dé", "x#", "f", f"w{r.randint(0, 99)}"]) for _ in range(r.choice([0, 3, 49, 50, 80]))) for _ in range(40)]
    texts += [None, "", " \n", "Ä" * 60, "long " * 30_000]
    rows = [(r.choice([i, i, None]), r.choice([*texts, "same", "same", "same"]), r.choice(["s", "t", None, ""])) for i in range(90)]
    rows += rows[:5] + [(3, "other", "s"), (None, "same", "t")]  # repeated rows, one id with two texts
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 90, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    assert got(spark, rows, labels) == brute(rows, labels)


def test_edges(spark):
    assert got(spark, [], []) == {}
    only = got(spark, [(None, None, None), (None, None, None)], [])
    assert len(only) == 600 and only["", "EABCD", 1] == [2, 0, 0, 0, 0, 0, 0] and only["", "AEBCD", 1][:2] == [0, 2]


def test_own_filters(spark):
    short = fa.Filter("S", lambda m: m["n_chars"] < 3)
    found = got(spark, [(1, "ab", "s"), (2, "ab", "s"), (3, "abcd", "s")], [(2, 1, 0)], filters=(short, fa.Filter("E")))
    assert found["s", "SE", 1] == [1, 2, 0, 1, 1, 0, 3] and found["s", "ES", 1] == [2, 1, 0, 0, 1, 0, 1] and found["s", "ES", 2] == [1, 1, 1, 1, 0, 0, 3]


def test_hot_text_is_no_join_key(spark):
    """Rows learn of copies by id and digest, not by the digest alone."""
    docs = spark.createDataFrame([(i, "same", "s", 1, "m", 1) for i in range(9)], DOCS)
    plan = fa.masks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter, \(\(doc_id#\d+L = doc_id#\d+L\) AND \(digest#\d+ = digest#\d+\)\)", plan)
    assert fa.masks(docs).where(F.col("mask").bitwiseAND(16) != 0).count() == 8
