"""CTC greedy decoding as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _emitted(steps: Column, blank: int) -> Column:
    """Steps (struct<c, p>) that differ from the step before and are not blank."""
    before = lambda i: steps[F.greatest(i - 1, F.lit(0))]["c"]
    return F.filter(steps, lambda s, i: (s["c"] != blank) & ((i == 0) | (s["c"] != before(i))))


def _spell(emitted: Column, vocabulary: Column) -> Column:
    known = F.filter(emitted, lambda s: (s["c"] >= 0) & (s["c"] < F.size(vocabulary)))
    return F.array_join(F.transform(known, lambda s: F.get(vocabulary, s["c"])), "")


def decode_indices(indices: Column, vocabulary: Column, blank: int = 0) -> Column:
    """struct<text, confidence>: repeats collapsed, blanks and unknown classes dropped, confidence 1."""
    steps = F.transform(indices, lambda c: F.struct(c.cast("int").alias("c"), F.lit(1.0).alias("p")))
    return F.struct(_spell(_emitted(steps, blank), vocabulary).alias("text"), F.lit(1.0).alias("confidence"))


def decode_logits(logits: Column, vocabulary: Column, blank: int = 0) -> Column:
    """struct<text, confidence>: first greatest class of each step (empty steps skipped); confidence is
    the mean of the emitted maxima within 0 and 1, 0 if nothing is emitted."""
    best = F.transform(F.filter(logits, lambda r: F.size(r) > 0), lambda r: F.struct((F.array_position(r, F.array_max(r)) - 1).cast("int").alias("c"), F.array_max(r).cast("double").alias("p")))
    out = _emitted(best, blank)
    total = F.aggregate(out, F.lit(0.0), lambda a, s: a + s["p"])
    mean = F.when(F.size(out) > 0, F.least(F.greatest(total / F.size(out), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.struct(_spell(out, vocabulary).alias("text"), mean.alias("confidence"))


def greedy_labels(logits: Column, blank: int = 0) -> Column:
    """Emitted class numbers of one sequence."""
    best = F.transform(F.filter(logits, lambda r: F.size(r) > 0), lambda r: F.struct((F.array_position(r, F.array_max(r)) - 1).cast("int").alias("c"), F.lit(1.0).alias("p")))
    return F.transform(_emitted(best, blank), lambda s: s["c"])


def align_timesteps(logits: Column, length: int) -> Column:
    """Linear interpolation along time to `length` steps, half-pixel centres, clamped at the ends."""
    n = F.size(logits)
    at = lambda t: F.greatest((t + 0.5) * n / F.lit(float(length)) - 0.5, F.lit(0.0))

    def step(t):
        lo = F.least(F.floor(at(t)).cast("int"), n - 1)
        hi = F.least(lo + 1, n - 1)
        w = at(t) - lo
        return F.zip_with(F.get(logits, lo), F.get(logits, hi), lambda a, b: a * (1 - w) + b * w)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), step))


def squeeze(logits: Column) -> Column:
    """[1, T, C] to [T, C]; any other leading size is an error."""
    return F.when(F.size(logits) == 1, logits[0]).otherwise(F.raise_error("logits must have one sequence"))


def logits_matrix(df: DataFrame, name: str) -> Column:
    """The column as [T, C]: of that shape already, or [1, T, C]; any other type is an error."""
    depth, kind = 0, df.schema[name].dataType
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    if depth not in (2, 3):
        raise ValueError(f"{name} must be [T, C] or [1, T, C], not of depth {depth}")
    return F.col(name) if depth == 2 else squeeze(F.col(name))
