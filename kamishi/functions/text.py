"""Japanese text normalization as Column expressions (code-point semantics, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width ASCII lies 0xFEE0 above ASCII; the ideographic space becomes a space.
FULL_ASCII = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
HALF_ASCII = "".join(chr(ord(c) - 0xFEE0) for c in FULL_ASCII[:-1]) + " "

# Half-width katakana and punctuation in code-point order, and their full-width forms.
HALF_KANA = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ"
FULL_KANA = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
# Kana that take the voiced (ﾞ) and semi-voiced (ﾟ) mark, and the composed forms.
VOICED = ("カキクケコサシスセソタチツテトハヒフヘホウ", "ガギグゲゴザジズゼゾダヂヅデドバビブベボヴ")
SEMI_VOICED = ("ハヒフヘホ", "パピプペポ")


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def halfwidth_ascii(s: Column) -> Column:
    return F.translate(s, FULL_ASCII, HALF_ASCII)


def _marked(s: Column) -> Column:
    return contains_any(s, ["ﾞ", "ﾟ"])


def _composed(s: Column) -> Column:
    """fullwidth_kana() of a text with marks."""
    out = F.translate(s, HALF_KANA, FULL_KANA)
    for mark, pairs in (("ﾞ", VOICED), ("ﾟ", SEMI_VOICED)):
        for a, b in zip(*pairs, strict=True):
            out = F.replace(out, F.lit(a + mark), F.lit(b))
    return F.translate(out, "ﾞﾟ", "゛゜")


def fullwidth_kana(s: Column) -> Column:
    """Half-width kana made full-width; a mark composes with the kana before it, alone it stands."""
    return F.when(_marked(s), _composed(s)).otherwise(F.translate(s, HALF_KANA, FULL_KANA))


def collapse_whitespace(s: Column) -> Column:
    """Per line: runs of space, tab and ideographic space become one space; ends are trimmed."""
    single = F.regexp_replace(s, "[ \\t\\u3000]+", " ")
    trimmed = F.regexp_replace(F.regexp_replace(single, r"(\A|\n) ", "$1"), r" (\n|\z)", "$1")
    # the patterns find nothing in a text without any of these
    return F.when(contains_any(s, ["  ", "\t", "\u3000", "\n ", " \n"]) | s.startswith(" ") | s.endswith(" "), trimmed).otherwise(s)


def normalize(s: Column, kana: bool = True, ascii: bool = True, whitespace: bool = False) -> Column:
    if kana and ascii:  # both in one pass, as no character of one table comes out of the other
        out = F.when(_marked(s), halfwidth_ascii(_composed(s))).otherwise(F.translate(s, HALF_KANA + FULL_ASCII, FULL_KANA + HALF_ASCII))
    else:
        out = fullwidth_kana(s) if kana else halfwidth_ascii(s) if ascii else s
    return let(out, collapse_whitespace) if whitespace else out


def normalize_all(s: Column) -> Column:
    return normalize(s, whitespace=True)


def contains_any(s: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | s.contains(word)
    return out


def escape_cell(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\n"), F.lit("<br>")), F.lit("|"), F.lit("\\|"))


def trim_name(s: Column) -> Column:
    """Product name without leader dots and markers."""
    return F.ltrim(F.rtrim(s, F.lit(" \t・:：*＊␣….-")), F.lit(" \t*＊"))


def strip_rates(s: Column) -> Column:
    return F.when(s.contains("%"), F.regexp_replace(s, r"\d{1,2}\s*%", "")).otherwise(s)


def trim_trailing_newlines(s: Column) -> Column:
    return F.regexp_replace(s, r"\n+\z", "")
