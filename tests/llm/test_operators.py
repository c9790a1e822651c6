"""Quality rules, line dedup, chat, tokenizer, search, packing and language ID on small inputs and edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kamishi.llm import chat, langid, line_dedup, packing, quality, search, unigram

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, kept string, n_words int, line string, word string"


def clash(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "l", None) for r in rows], CLASH)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d e f g h i j k l"), (4, "a b c d e f g h i j k l"), (4, "a b c d e f g h i j k l")]


def test_quality(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcde") * r.randint(1, 3) for _ in range(r.randint(0, 60))) + r.choice(["", "\n# x\n# x"]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality.add_metrics(df).collect():
        w = WORD.findall(row.text)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        lines = [x for x in row.text.split("\n") if WORD.search(x)]
        assert (row.n_words, row.word_chars, row.n_repeat_words, row.n_dup_lines) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
    a = quality.quality_filter(df, order=list(quality.RULES)).select("doc_id", "kept").orderBy("doc_id").collect()
    b = quality.quality_filter(df, order=list(quality.RULES)[::-1]).select("doc_id", "kept").orderBy("doc_id").collect()
    assert a == b
    assert quality.quality_filter(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.n_words for r in quality.add_metrics(spark.createDataFrame(EDGES, "doc_id long, text string")).collect()] == [0, 0, 0, 12, 12, 12]
    assert [x.name for x in quality.order_rules([(quality.RULES[0], 2.0, 0.1), (quality.RULES[1], 1.0, 0.4)])] == ["repetitive", "too_short"]


def brute_verdict(text):
    """Names of the rules that reject the text."""
    w, lines, parts = WORD.findall(text or ""), (text or "").split("\n"), (text or "").split("\n\n")
    pairs = [tuple(w[i : i + 2]) for i in range(len(w) - 1)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    repeats = lambda xs: len(xs) - len(set(xs))
    n, chars = len(w), sum(map(len, w))
    return {
        "too_short": n < 10, "repetitive": 100 * len(cover) > 20 * n, "symbols": 10 * sum(c in "#*$%&|<>" for c in text or "") > n,
        "repeated_lines": 10 * repeats([x for x in lines if WORD.search(x)]) > 3 * len(lines), "word_length": not 2 * n <= chars <= 12 * n,
        "bullets": 10 * sum(x.lstrip(" ").startswith(("- ", "* ", "•")) for x in lines) > 9 * len(lines),
        "ellipses": 10 * sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) > 3 * len(lines),
        "few_letters": 10 * sum(any(c.isalpha() for c in x) for x in w) < 7 * n, "poor_vocabulary": n >= 100 and 10 * len(set(w)) < n,
        "repeated_paragraphs": 10 * repeats([x for x in parts if WORD.search(x)]) > 3 * len(parts),
        "top_pair": n >= 50 and 100 * max([pairs.count(p) for p in pairs], default=0) > 10 * n,
    }


def test_quality_rules(spark):
    """Every rule against brute force, in any order; user columns with the names of metrics stay."""
    r = random.Random(5)
    names = ["alpha", "bravo", "charlie", "delta", "1234", "niño", "...", "§§"]
    prose = lambda n, vocabulary=10**6: " ".join(f"{r.choice('abcdefg')}word{r.randint(0, vocabulary)}" for _ in range(n))
    texts = [None, "", prose(5), prose(60), prose(200, 1), prose(30) + " # # # # #", "\n".join("- " + prose(3) for _ in range(9)), "\n".join(prose(6) + "..." for _ in range(5))]
    texts += [" ".join("12 34".split() * 9 + [prose(2)]), "\n\n".join([prose(12)] * 2 + ["x"]), " ".join(["x y"] * 12) + " " + prose(60), "\n".join([prose(4)] * 5 + [prose(9)]), " ".join("x" * 30 + str(i) for i in range(15))]
    texts += [r.choice(["\n", " ", "\n\n"]).join(r.choice(names) for _ in range(r.randint(0, 120))) for _ in range(40)]
    docs = clash(spark, enumerate(texts))
    wanted = {i: {k for k, bad in brute_verdict(t).items() if bad} for i, t in enumerate(texts)}
    assert set().union(*wanted.values()) == {x.name for x in quality.RULES}
    order = list(quality.RULES)
    for _ in range(2):
        r.shuffle(order)
        for row in quality.quality_filter(docs, order=order).collect():
            first = next((x.name for x in order if x.name in wanted[row.doc_id]), None)
            assert (row.failed_rule, row.kept, row.n_words, row.line) == (first, first is None, 1, "l")


def test_quality_splits_once(spark, tmp_path):
    """Words are split off once for all metrics and rules; the sample comes from a few files."""
    rows = [(i, f"some words of text {i} " * (i % 7)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(20).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plan = quality.quality_filter(docs, order=list(quality.RULES), report=quality.REPORTED)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") - plan.count("\n, -1)") - plan.count("\n\n, -1)") <= 1, plan
    sample = quality.sample_of(docs, 10, 4)
    assert 4 <= len(sample.inputFiles()) <= 5 and 0 < sample.count() <= 15
    found = quality.estimate(docs, report=quality.REPORTED)
    assert [r for r, _, _ in found] == list(quality.RULES) and all(cost > 0 and 0 <= share <= 1 for _, cost, share in found)
    assert {r.doc_id for r in quality.quality_filter(docs).where("kept").collect()} == {i for i, t in rows if not brute_verdict(t)}


def test_lines(spark):
    rows = [(i, "Head \n" + f"own {i}\n" + ("tail" if i % 2 else "x")) for i in range(12)] + [(50, None), (51, ""), (None, "HEAD\nz")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (3, 1, "own 0\nx") and got[1] == (3, 1, "own 1\ntail") and got[50] == (1, 0, "") and got[None] == (2, 1, "z")
    first = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(spark.createDataFrame(rows[:12], "doc_id long, text string"), min_docs=1, keep_first=True).collect()}
    assert first[0] == "Head \nown 0\nx" and first[1] == "own 1\ntail" and first[2] == "own 2"
    assert line_dedup.apply_bitmaps(clash(spark, EDGES), line_dedup.line_bitmaps(clash(spark, EDGES))).count() == 6
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a\\</turn>\n### x"), (1, 1, "assistant", "\\"), (1, 2, "assistant", "</part>"), (1, 3, None, None), (2, 200, "assistant", "b"), (2, 3, "a:b", "\\h\\\\s"), (None, 0, "user", "")]
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = done.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.t], r.loss) for r in back}
    assert got[1] == ([("user", "a\\</turn>\n### x"), ("assistant", "\\"), ("assistant", "</part>"), ("", "")], "\\</part>")
    assert got[2] == ([("a:b", "\\h\\\\s"), ("assistant", "b")], "b") and got[None] == ([("user", "")], "")
    assert next(r.formatted for r in back if r.conv_id == 1).count("### assistant: ") == 1
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load()


def test_tokenizer(spark, vocabulary):
    texts = [None, "", " ", "  a  b\n c", "😀 日本語", "x" * 3000, "The tokenizer", "The tokenizer"]
    df = clash(spark, list(enumerate(texts)))
    out = unigram.decode_ids(unigram.encode(df, vocabulary), vocabulary).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == texts and out[0].ids is None and out[1].ids == []
    score = dict(zip(vocabulary.ids.tolist(), vocabulary.scores.tolist(), strict=True))
    by_text = {vocabulary.pieces[i]: s for i, s in score.items()}
    for word in ("▁tokenizer", "▁Größenverhältnis", "▁antidisestablish"):
        b = word.encode()
        best = [0.0] + [-1e30] * len(b)
        for e in range(1, len(b) + 1):
            best[e] = max((best[s] + by_text[b[s:e]] for s in range(e) if b[s:e] in by_text), default=-1e30)
        ids = unigram.segment([b], vocabulary)[0]
        assert abs(sum(score[i] for i in ids) - best[-1]) < 1e-9
    assert unigram.encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0


def test_search(spark):
    import math

    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdefghij") + str(int(r.paretovariate(0.6)) % 300) for _ in range(r.randint(1, 60)))) for i in range(400)] + [(900, None), (901, ""), (902, "A1 a1")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for row in search.search(df, df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 5).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.doc_id, row.score))
    bags = {d: WORD.findall(t.lower()) for d, t in docs if t is not None}
    mean = sum(map(len, bags.values())) / len(bags)
    df_of = {}
    for b in bags.values():
        for t in set(b):
            df_of[t] = df_of.get(t, 0) + 1
    for q in range(0, 400, 20):
        scores = []
        for d, b in bags.items():
            s = sum(math.log(1 + (len(bags) - df_of[t] + 0.5) / (df_of[t] + 0.5)) * b.count(t) * 2.2 / (b.count(t) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for t in bags[q] if t in b)
            if s > 0:
                scores.append((-round(s, 9), d))
        want = [(i + 1, d, round(-s, 6)) for i, (s, d) in enumerate(sorted(scores)[:5])]
        assert [(a, b) for a, b, _ in sorted(got[q])] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 2e-6 for x, y in zip(sorted(got[q]), want, strict=True))


def test_packing(spark):
    r = random.Random(5)
    rows = [(i, r.choice([0, 5, 40, 100, 700]), "x") for i in range(300)] + [(1, 7, "again"), (None, 9, "n"), (7, None, "m")]
    df = spark.createDataFrame(rows, "doc_id long, n int, bin string")
    out = packing.pack(df, F.col("n"), (64, 128, 256)).collect()
    assert sum(p.length for p in out) == sum(n or 0 for _, n, _ in rows)
    bins = {}
    for p in out:
        bins.setdefault((p.shard, p.bin), []).append(p)
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.position):
            assert p.start == at
            at += p.length
        assert at <= pieces[0].capacity and all(c < at for c in (64, 128, 256) if c < pieces[0].capacity)
    assert packing.best_fit([100, 60, 4], (64, 128), float)[0] == (0, 0)
    assert packing.pack(df.where("false"), F.col("n")).count() == 0
    assert sorted((p.doc_id, p.piece, p.length) for p in packing.pack(spark.createDataFrame([(3, 'x ' * 9000), (4, None), (5, ' ')], 'doc_id long, text string')).collect()) == [(3, 0, 4096), (3, 1, 4096), (3, 2, 808)]
    assert sum(p.doc_id is None for p in out) == 1


def test_language(spark):
    r = random.Random(9)
    make = {"xx": "abcde", "yy": "vwxyz", "zz": "бгджз"}
    text = lambda c, n: " ".join("".join(r.choice(c) for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [(i, text(make[k], r.randint(5, 40)), k) for i in range(200) for k in [r.choice(list(make))]] + [(500, None, "xx"), (501, "12 34", "yy"), (502, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where(~langid.is_held_out()))
    out = langid.identify(df, model, spans=True).collect()
    assert sum(p.lang == p.lang_pred for p in out if p.doc_id < 500) >= 198 and all(0 <= p.score <= 1 for p in out)
    assert {p.lang_pred for p in out if p.doc_id >= 500} == {"und"}
    mixed = spark.createDataFrame([(1, text(make["xx"], 10) + " " + text(make["yy"], 10))], "doc_id long, text string")
    assert [s.lang for s in langid.identify(mixed, model, spans=True).first().spans] == ["xx", "yy"]
    nothing = langid.train(df.where("false"))
    assert langid.identify(df.select("doc_id", "text"), nothing).first().lang_pred == "und"
