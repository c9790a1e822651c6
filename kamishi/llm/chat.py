r"""Chat formatting with Spark expressions only.

A conversation becomes blocks `### role: text</part>text</turn>\n`, one block per run of adjacent
turns of one role. Inside roles and texts `\` is written `\\`, `###` is `\h`, `</` is `\s` and, in
roles, `:` is `\c`, so no control string survives in a text and reading back is exact.

Rows of a conversation are ordered by turn (null first), then role, then text; repeated rows stay.
Null texts and roles are empty strings. A null conv_id is a conversation of its own. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

OPEN, NAMED, PART, CLOSE = "### ", ": ", "</part>", "</turn>\n"
#: Turns gathered together before a conversation is: a long one then moves as few, already sorted rows.
SEGMENT = 64


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\h")), F.lit("</"), F.lit("\\s"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    """Doubled backslashes are split off first: what lies between them holds only single escapes."""

    def plain(piece):
        out = F.replace(F.replace(piece, F.lit("\\h"), F.lit("###")), F.lit("\\s"), F.lit("</"))
        return F.replace(out, F.lit("\\c"), F.lit(":")) if role else out

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: [start, end) in code points of each assistant text."""
    rows = turns.select(
        "conv_id", F.floor(F.col("turn") / SEGMENT).alias("seg"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    segments = rows.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    convs = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "ts"))).alias("segs"))
    # sorted as they are, then escaped: escaping changes the order of texts
    escaped = lambda t: F.struct(escape(t["role"], role=True).alias("role"), escape(t["text"]).alias("text"))
    flat = convs.select("conv_id", F.transform(F.flatten("segs.ts"), escaped).alias("ts"))
    t = F.col("ts")
    opens = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.when(i == 0, True).otherwise(t[i]["role"] != t[F.greatest(i - 1, F.lit(0))]["role"]))
    edged = flat.withColumn("opens", opens)
    o = F.col("opens")
    nxt = lambda j: F.coalesce(F.get(o, j + 1), F.size(t))
    merged = F.transform(o, lambda i, j: F.struct(t[i]["role"].alias("role"), F.transform(F.slice(t, i + 1, nxt(j) - i), lambda x: x["text"]).alias("texts")))
    blocks = edged.select("conv_id", merged.alias("blocks"))
    # Pieces in order: scaffolding and texts in turn, texts of the assistant under the loss mask.
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def pieces(b):
        head = piece(F.concat(F.lit(OPEN), b["role"], F.lit(NAMED)), no)
        body = F.flatten(F.transform(b["texts"], lambda x, k: F.array(piece(F.when(k > 0, PART).otherwise(""), no), piece(x, b["role"] == "assistant"))))
        return F.concat(F.array(head), body, F.array(piece(F.lit(CLOSE), no)))

    laid = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("ps"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a, p):
        end = a["at"] + F.char_length(p["s"])
        span = F.array(F.struct(a["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return laid.select("conv_id", F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("formatted"), F.aggregate("ps", start, step, lambda a: a["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds, as array<struct<role, text>>, one per original row."""
    blocks = F.split(formatted, CLOSE)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(b):
        at = F.instr(b, NAMED)
        role = unescape(F.substring(b, F.lit(len(OPEN) + 1), at - len(OPEN) - 1), role=True)
        texts = F.split(F.substring(b, at + len(NAMED), F.char_length(b)), PART)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def op5(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    done = format_chats(rows.unionByName(extra))
    back = done.withColumns({"turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("loss_spans"))})
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</', '\s') AS et,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</', '\s'), ':', '\c') AS er,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(et) + CASE WHEN before IS NULL OR before <> role THEN length(er) + 6 + 8 ELSE 7 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
