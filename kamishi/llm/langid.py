"""Language ID: spans of mixed-language text by Viterbi over per-word scores.

A word's script (a fixed table of code-point ranges, read from its first letter's bytes) narrows the
candidates to the languages whose training texts use that script. Candidates are scored by byte
trigrams (naive Bayes, add-one) and a Viterbi pass with a switching penalty labels each word. A text's language is
the one with most word bytes; its score is that share, times the mean certainty of those words. The
score only ranks the learned languages; whether a text is in one of them at all is said by `foreign`:
most letters are in scripts that none uses, or a letter's mean log likelihood (words without digits)
lies under the floor of its language, eight deviations below the mean of the training texts, each left
out of the counts that judge it.

Null text, or text without a letter, is `und` with score 0. Empty training data makes every text
`und`. Rows with null lang or text train nothing. Repeated rows get equal answers. An empty table
gives an empty result. Columns besides doc_id, text and (for training) lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesvec as bv
from .common import table

FEATURES = 1 << 16
SWITCH_PENALTY = 12.0
UNSEEN = "und"
CHUNK_BYTES = 1 << 20
#: Deviations below the mean of the training texts at which a text is foreign; the least deviation.
FLOOR_DEVIATIONS, LEAST_DEVIATION = 8.0, 0.3

# First code points of letter ranges and their scripts (Unicode block boundaries).
SCRIPT_STARTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
_IDS = np.array([SCRIPTS.index(n) for _, n in SCRIPT_STARTS])
NO_SCRIPT = len(SCRIPTS)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def is_held_out() -> Column:
    """Documents that train nothing: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hashed byte trigram (A-Z lower-cased, white space as one value) that ends at each byte; it
    reaches back neither over white space nor over the start of a text."""
    low = bv.LOWER[buf].astype(np.uint32)
    low[bv.IS_SPACE[buf]] = 32
    one = np.concatenate((np.full(1, 32, np.uint32), low))[: len(low)]
    one[offs[:-1][offs[:-1] < len(low)]] = 32
    two = np.concatenate((np.full(1, 32, np.uint32), one))[: len(low)]
    two[one == 32] = 32
    return ((low * 40503 + one * 10007 + two * 30011 + (one * two) * 7) & (FEATURES - 1)).astype(np.int64)


def scripts_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Script of each word's first letter; NO_SCRIPT without one."""
    lead = _LETTER[buf] | (buf >= 0xC3)
    lead_at = np.append(np.flatnonzero(lead), len(buf))
    at = lead_at[np.searchsorted(lead_at, starts)]
    has = at < ends
    at = np.minimum(at, max(len(buf) - 1, 0))
    b = [buf[np.minimum(at + k, max(len(buf) - 1, 0))].astype(np.int64) for k in range(4)]
    point = np.where(
        b[0] < 0x80, b[0],
        np.where(b[0] < 0xE0, (b[0] & 31) << 6 | b[1] & 63, np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63)),
    )
    return np.where(has, _IDS[np.maximum(np.searchsorted(_STARTS, point, "right") - 1, 0)], NO_SCRIPT)


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(_LETTER[buf])))
    yes = sums[offs[1:]] > sums[offs[:-1]]
    for i in np.flatnonzero(~yes & (offs[1:] > offs[:-1])):
        yes[i] = any(ch.isalpha() for ch in buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return yes


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # languages x FEATURES
    scripts: np.ndarray  # languages x scripts: whether the language uses the script
    totals: np.ndarray  # of each language, the sum of its counts, each with the one added


def labelled(docs: DataFrame) -> DataFrame:
    """The rows that train: lang and text of all that have both."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")


def _by_language(batches):
    """(language of each run, first text of each run and the end, texts) of slices of about CHUNK_BYTES, texts in order of language."""
    for batch in batches:
        for lo, hi in bv.slices(batch.column("text"), CHUNK_BYTES):
            part = pa.Table.from_batches([batch.slice(lo, hi - lo)]).sort_by("lang")
            code = part.column("lang").combine_chunks().dictionary_encode()
            code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
            of = code.indices.to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
            yield code.dictionary.take(code.indices.take(pa.array(edge[:-1]))).to_pylist(), edge, part.column("text")
    bv.release()


def _count(batches):
    """(lang, kind, slot, n): trigram and script counts of each language in this task."""
    trigrams, scripts = {}, {}
    for langs, edge, texts in _by_language(batches):
        buf, offs = bv.buffer_of(texts)
        f = features(buf, offs)
        starts, ends, woffs = bv.word_spans(buf, offs)
        script = scripts_of(buf, starts, ends)
        for lang, lo, hi in zip(langs, edge[:-1], edge[1:], strict=True):
            trigrams[lang] = trigrams.get(lang, 0) + np.bincount(f[offs[lo] : offs[hi]], minlength=FEATURES)
            scripts[lang] = scripts.get(lang, 0) + np.bincount(script[woffs[lo] : woffs[hi]], minlength=NO_SCRIPT + 1)
    for kind, counts in ((0, trigrams), (1, scripts)):
        for lang, n in counts.items():
            at = np.flatnonzero(n) if kind == 0 else np.arange(len(n))  # a language without a word still has its scripts' zeros
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(n[at])], ["lang", "kind", "slot", "n"])


def train(docs: DataFrame) -> Model:
    """Learn from all rows with text and lang.

    What reaches the driver is bounded by languages times FEATURES.
    """
    counts = labelled(docs).mapInArrow(_count, "lang string, kind int, slot long, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(set(counts["lang"])))
    logp, scripts = np.ones((len(langs), FEATURES)), np.zeros((len(langs), NO_SCRIPT + 1))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        t, s = own[own["kind"] == 0], own[own["kind"] == 1]
        logp[i, t["slot"]] += t["n"]
        scripts[i, s["slot"]] = s["n"]
    uses = scripts > 0.001 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    totals = logp.sum(axis=1)
    return Model(langs, np.log(logp / totals[:, None]).astype(np.float32), uses, totals)


def judged(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Letter bytes of words without a digit."""
    digits = np.concatenate(([0], np.cumsum((buf >= 48) & (buf <= 57))))
    plain = digits[ends] == digits[starts]
    edge = np.zeros(len(buf) + 1, np.int64)
    np.add.at(edge, starts[plain], 1)
    np.add.at(edge, ends[plain], -1)
    return (np.cumsum(edge)[:-1] > 0) & (_LETTER[buf] | (buf >= 0xC3) | ((buf >= 0x80) & (buf < 0xC0)))


def _own_counts(f: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often the text of each byte has the byte's feature; texts in order."""
    order = np.argsort(f.astype(np.uint16), kind="stable")
    f, doc = f[order], doc[order]
    n = np.diff(np.flatnonzero(np.concatenate(([True], (f[1:] != f[:-1]) | (doc[1:] != doc[:-1]), [True]))))
    out = np.empty(len(f), np.int64)
    out[order] = np.repeat(n, n)
    return out


def _likelihoods(shared):
    """(lang, x): log likelihood of a letter in each training text by the counts of the others."""

    def run(batches):
        model = shared.value
        number = {lang: i for i, lang in enumerate(model.langs)}
        for langs, edge, texts in _by_language(batches):
            buf, offs = bv.buffer_of(texts)
            if not len(buf):
                continue
            starts, ends, _ = bv.word_spans(buf, offs)
            size, f, keep = np.diff(offs), features(buf, offs), judged(buf, starts, ends)
            doc = np.repeat(np.arange(len(size)), size)
            own = _own_counts(f, doc)
            of = np.repeat([number[k] for k in langs], np.diff(edge))  # the language of each text
            f, own, doc = f[keep], own[keep], doc[keep]
            rest = np.maximum(np.exp(model.logp[of[doc], f].astype(np.float64)) * model.totals[of[doc]] - own, 1)
            letters = np.bincount(doc, minlength=len(size))
            some = np.flatnonzero(letters)
            x = np.bincount(doc, np.log(rest), len(size))[some] / letters[some] - np.log(np.maximum(model.totals[of[some]] - size[some], 1))
            yield pa.RecordBatch.from_arrays([pa.array([model.langs[i] for i in of[some]], pa.string()), pa.array(x, pa.float64())], ["lang", "x"])

    return run


def floors(docs: DataFrame, model: Model) -> np.ndarray:
    """Least log likelihood of a letter, by language, at which a text is still taken for it: from all rows with text and lang."""
    out = np.full(len(model.langs), -np.inf)
    if len(out):
        for r in labelled(docs).mapInArrow(_likelihoods(docs.sparkSession.sparkContext.broadcast(model)), "lang string, x double").groupBy("lang").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).collect():
            out[model.langs.index(r["lang"])] = r["mean"] - FLOOR_DEVIATIONS * max(r["sd"], LEAST_DEVIATION)
    return out


def is_foreign(model: Model, floor: np.ndarray, texts, starts, ends, doc, label, top) -> np.ndarray:
    """Texts in no learned language, given their words' labels and their own."""
    n = len(top)
    buf, offs = bv.buffer_of(texts)
    script = scripts_of(buf, starts, ends)
    lettered = (ends - starts) * (script != NO_SCRIPT)
    unknown = np.bincount(doc, lettered * ~model.scripts.any(axis=0)[script], n)
    keep, f = judged(buf, starts, ends), features(buf, offs)
    own = np.zeros(len(starts))
    for i in range(len(model.langs)):
        sums = np.concatenate(([0.0], np.cumsum(model.logp[i][f] * keep, dtype=np.float64)))
        own = np.where(label == i, sums[ends] - sums[starts], own)
    count = np.concatenate(([0], np.cumsum(keep)))
    letters = np.bincount(doc, count[ends] - count[starts], n)
    low = np.bincount(doc, own, n) < floor[top] * letters
    return (2 * unknown > np.bincount(doc, lettered, n)) | (low & (letters > 0))


def word_scores(model: Model, buf, offs, starts, ends, woffs) -> np.ndarray:
    """Words x languages; languages outside the word's script are out of reach."""
    f = features(buf, offs)
    until = ends + (ends < np.repeat(offs[1:], np.diff(woffs)))  # with the white space that ends the word
    out = np.empty((len(starts), len(model.langs)), np.float32)
    for i in range(len(model.langs)):
        sums = np.concatenate(([0.0], np.cumsum(model.logp[i][f], dtype=np.float64)))
        out[:, i] = sums[until] - sums[starts]
    allowed = model.scripts.T[scripts_of(buf, starts, ends)]
    allowed |= ~allowed.any(axis=1, keepdims=True)  # a script that no language uses narrows nothing
    return np.where(allowed, out, out.min(axis=1, keepdims=True) - 50)


def viterbi(scores: np.ndarray, offs: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word, all texts of a batch in step; longest texts first."""
    n = np.diff(offs)
    order = np.argsort(-n, kind="stable")
    begin, n = offs[:-1][order], n[order]
    n_langs = scores.shape[1]
    best = np.zeros((len(n), n_langs), np.float32)
    back = np.empty((scores.shape[0], n_langs), np.int16)
    live = np.searchsorted(-n, -np.arange(1, int(n.max(initial=0)) + 1), "right")
    for t, m in enumerate(live):
        at = begin[:m] + t
        own = best[:m]
        top = own.argmax(axis=1)
        jump = own[np.arange(m), top] - penalty
        switch = own < jump[:, None]
        back[at] = np.where(switch, top[:, None], np.arange(n_langs))
        best[:m] = np.where(switch, jump[:, None], own) + scores[at]
    label = np.zeros(scores.shape[0], np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = begin[:m] + t
        label[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return label


def label_words(model: Model, texts, penalty: float = SWITCH_PENALTY):
    """(starts, ends, word offsets, labels, certainty of each word's label, has_letter) of some texts."""
    buf, offs = bv.buffer_of(texts)
    starts, ends, woffs = bv.word_spans(buf, offs)
    scores = word_scores(model, buf, offs, starts, ends, woffs)
    label = viterbi(scores, woffs, penalty)
    high = scores.max(axis=1, keepdims=True)
    odds = np.exp(np.minimum(scores - high, 0))
    sure = odds[np.arange(len(label)), label] / odds.sum(axis=1) if len(label) else np.zeros(0)
    return starts, ends, woffs, offs, label, sure, has_letter(buf, offs)


def _predict(shared, penalty, spans, floor):
    def run(batches):
        model = shared.value
        for batch in batches:
            for lo, hi in bv.slices(batch.column("text"), CHUNK_BYTES):
                part = batch.slice(lo, hi - lo)
                n = part.num_rows
                names, scores, found = [UNSEEN] * n, np.zeros(n), [[] for _ in range(n)]
                foreign = np.ones(n, bool)
                if model.langs:
                    starts, ends, woffs, offs, label, sure, letters = label_words(model, part.column("text"), penalty)
                    size = (ends - starts).astype(np.float64)
                    doc = np.repeat(np.arange(n), np.diff(woffs))
                    k = len(model.langs)
                    mass = np.bincount(doc * k + label, weights=size, minlength=n * k).reshape(n, k)
                    certain = np.bincount(doc * k + label, weights=size * sure, minlength=n * k).reshape(n, k)
                    top = mass.argmax(axis=1)
                    total = np.maximum(mass.sum(axis=1), 1e-9)
                    scores = np.where(letters, np.clip(certain[np.arange(n), top] / total, 0, 1), 0.0)
                    names = [model.langs[t] if ok else UNSEEN for t, ok in zip(top, letters, strict=True)]
                    if floor is not None:
                        foreign = is_foreign(model, floor, part.column("text"), starts, ends, doc, label, top)
                    if spans:
                        edge = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])))) if len(label) else []
                        for a, b in zip(edge, [*edge[1:], len(label)], strict=True) if len(label) else []:
                            d = doc[a]
                            found[d].append({"start": int(starts[a] - offs[d]), "end": int(ends[b - 1] - offs[d]), "lang": model.langs[label[a]]})
                out = [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                fields = [*part.schema.names, "lang_pred", "score"]
                if spans:
                    out.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                    fields.append("spans")
                if floor is not None:
                    out.append(pa.array(foreign))
                    fields.append("foreign")
                yield pa.RecordBatch.from_arrays(out, fields)
        bv.release()

    return run


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, spans: bool = False, floor: np.ndarray | None = None) -> DataFrame:
    """docs with lang_pred, score and, if asked for, spans (byte start, byte end, lang) and, given floors, foreign.

    Columns of docs with these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", *["spans"] * spans, *["foreign"] * (floor is not None))
    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
        extra.append(T.StructField("spans", T.ArrayType(span)))
    if floor is not None:
        extra.append(T.StructField("foreign", T.BooleanType()))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of hashed trigrams for each language
    return docs.mapInArrow(_predict(shared, penalty, spans, floor), T.StructType([*docs.schema.fields, *extra]))


def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~is_held_out() | F.col("doc_id").isNull()))
    done = identify(docs.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score")
    return done.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
