"""Labels and scores of words against plain loops over every label sequence."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from kamishi.llm import langid

LANGS = {"xx": "abcdefg", "yy": "defghij", "zz": "бгджзик"}
SPACE = " \t\n\x0b\x0c\r"


def prose(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n))


def slots(text):
    """The feature of every byte of a text: its lower-cased trigram, not over white space."""
    out, one, two = [], 32, 32
    for byte in text.encode():
        low = 32 if chr(byte) in SPACE else byte + 32 if 65 <= byte <= 90 else byte
        two = 32 if one == 32 else two
        out.append((low * 40503 + one * 10007 + two * 30011 + one * two * 7) % 2**32 % langid.FEATURES)
        one, two = low, one
    return out


def logs(counts):
    whole = sum(counts)
    return [math.log(x / whole) for x in counts]


@pytest.fixture(scope="module")
def learned(spark):
    r = random.Random(1)
    rows = [(i, prose(r, LANGS[lang], r.randint(3, 30)), lang) for i in range(60) for lang in LANGS] + [(900, None, "xx"), (901, "abc", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: [1] * langid.FEATURES for lang in LANGS}
    for _, text, lang in rows:
        for slot in slots(text) if text and lang else ():
            counts[lang][slot] += 1
    return model, {lang: logs(c) for lang, c in counts.items()}


def plain(text, logp, penalty):
    """[(start, end)] of the words and the scores of each in the languages of its script."""
    raw, f = text.encode(), slots(text)
    words, at = [], 0
    while at < len(raw):
        if chr(raw[at]) in SPACE:
            at += 1
            continue
        end = at
        while end < len(raw) and chr(raw[end]) not in SPACE:
            end += 1
        words.append((at, end))
        at = end
    scores = []
    for a, b in words:
        first = next((c for c in raw[a:b].decode() if c.isalpha()), None)
        allowed = [k for k in LANGS if first is not None and (first in "абвгджзиклмн") == (k == "zz")] or list(LANGS)
        own = {k: sum(logp[k][s] for s in f[a : min(b + 1, len(raw))]) for k in LANGS}
        scores.append({k: own[k] if k in allowed else min(own.values()) - 50 for k in LANGS})
    return words, scores


def total(path, scores, penalty):
    return sum(s[k] for k, s in zip(path, scores, strict=True)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("penalty", [0.5, 12.0])
def test_labels_and_scores(spark, learned, penalty):
    model, logp = learned
    assert model.langs == tuple(LANGS) and np.allclose(model.logp, [logp[k] for k in model.langs], atol=1e-5)
    r = random.Random(7)
    texts = [" ".join(prose(r, LANGS[r.choice(list(LANGS))], r.randint(1, 3)) for _ in range(r.randint(1, 2))) for _ in range(60)]
    texts += ["Abc\tDEF\n gh", "12 abc 7", "абв abc", "defg"]
    starts, ends, woffs, offs, label, sure, _ = langid.label_words(model, pa.array(texts), penalty)
    found = {x.doc_id: x for x in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, penalty).collect()}
    for i, text in enumerate(texts):
        words, scores = plain(text, logp, penalty)
        here = slice(woffs[i], woffs[i + 1])
        assert [(int(a - offs[i]), int(b - offs[i])) for a, b in zip(starts[here], ends[here], strict=True)] == words
        best = max(total(p, scores, penalty) for p in itertools.product(LANGS, repeat=len(words)))
        path = [model.langs[k] for k in label[here]]
        assert abs(total(path, scores, penalty) - best) < 1e-2
        certain = [1 / sum(math.exp(min(s[o] - max(s.values()), 0)) / math.exp(min(s[k] - max(s.values()), 0)) for o in LANGS) for k, s in zip(path, scores, strict=True)]
        assert np.allclose(sure[here], certain, atol=1e-3)
        mass = {k: sum(b - a for (a, b), p in zip(words, path, strict=True) if p == k) for k in LANGS}
        top = max(LANGS, key=lambda k: mass[k])
        want = sum((b - a) * c for (a, b), c, p in zip(words, certain, path, strict=True) if p == top) / sum(mass.values())
        assert found[i].lang_pred == top and abs(found[i].score - want) < 1e-3


def test_edges(spark, learned):
    """Null, letterless and repeated texts, clashing columns, an empty table."""
    model, _ = learned
    rows = [(1, None, "a", 1), (2, "", "b", 2), (None, "12 %", "c", 3), (4, "abc cba", "d", 4), (4, "abc cba", "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(docs, model, spans=True).collect()
    assert [(r.doc_id, r.lang, r.lang_pred) for r in got] == [(1, "a", "und"), (2, "b", "und"), (None, "c", "und"), (4, "d", "xx"), (4, "d", "xx")]
    assert [r.score == 0 for r in got] == [True] * 3 + [False] * 2 and got[3].spans == got[4].spans
    assert langid.identify(docs.where("false"), model).count() == 0


def test_learns_from_every_row(spark):
    """Counts and floors of a language of more than 4,000 rows, against plain loops over all of them."""
    r = random.Random(3)
    rows = [(i, prose(r, LANGS["xx"], r.randint(1, 3)), "xx") for i in range(4500)] + [(5000, "abc 12 d3", "yy"), (5001, "7", "yy"), (5002, "", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs)
    counts = {k: [1] * langid.FEATURES for k in LANGS}
    for _, text, lang in rows:
        for slot in slots(text):
            counts[lang][slot] += 1
    assert model.langs == tuple(LANGS) and np.allclose(model.logp, [logs(c) for c in counts.values()], atol=1e-5)
    found = {k: [] for k in LANGS}
    for _, text, lang in rows:
        f, at, own = slots(text), 0, []
        for word in text.split(" "):
            if not any(c.isdigit() for c in word):
                own += f[at : at + len(word)]
            at += len(word) + 1
        if own:
            rest = [max(counts[lang][s] - f.count(s), 1) for s in own]
            found[lang].append(sum(map(math.log, rest)) / len(rest) - math.log(max(sum(counts[lang]) - len(f), 1)))
    want = [np.mean(x) - langid.FLOOR_DEVIATIONS * max(np.std(x), langid.LEAST_DEVIATION) if x else -np.inf for x in found.values()]
    assert np.allclose(langid.floors(docs, model), want, atol=1e-5)
