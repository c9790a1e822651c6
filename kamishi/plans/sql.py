"""The SQL surface: scalar functions that Catalyst inlines, and a table function from boxes to ordered lines."""

from __future__ import annotations

import json
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf

from ..functions import dates, geometry, numbers, text
from ..operators import layout

#: name: (arguments, expression of them).
SCALARS = {
    "halfwidth_ascii": ("s STRING", lambda s: text.halfwidth_ascii(s)),
    "fullwidth_kana": ("s STRING", lambda s: text.fullwidth_kana(s)),
    "collapse_whitespace": ("s STRING", lambda s: text.collapse_whitespace(s)),
    "normalize_text": ("s STRING", lambda s: text.normalize_all(s)),
    "escape_cell": ("s STRING", lambda s: text.escape_cell(s)),
    "trim_name": ("s STRING", lambda s: text.trim_name(s)),
    "strip_rates": ("s STRING", lambda s: text.strip_rates(s)),
    "parse_amount": ("s STRING", lambda s: numbers.parse_amount(s)),
    "amounts": ("s STRING", lambda s: numbers.amounts(s)),
    "standalone_amount": ("s STRING", numbers.standalone_amount),
    "kanji_number": ("s STRING", numbers.kanji_number),
    "parse_date": ("s STRING", lambda s: dates.parse_date(s)),
    "parse_time": ("s STRING", lambda s: dates.parse_time(s)),
    "classify_region": ("width DOUBLE, height DOUBLE", geometry.classify_region),
    "overlap_ratio": ("lo_a DOUBLE, hi_a DOUBLE, lo_b DOUBLE, hi_b DOUBLE", geometry.overlap_ratio),
    "interval_gap": ("lo_a DOUBLE, hi_a DOUBLE, lo_b DOUBLE, hi_b DOUBLE", geometry.gap),
}


class _Printer:
    """SQL text of an analyzed expression, lambda functions included.

    Spark prints every expression but lambda functions, their variables and the names of a struct's fields.
    A node above one of those is printed over attributes that stand for its children, and the children's own
    text is put in their place.
    """

    OWN = ("LambdaFunction", "NamedLambdaVariable", "CreateNamedStruct")

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.catalyst, self.types = self.jvm.org.apache.spark.sql.catalyst.expressions, self.jvm.org.apache.spark.sql.types
        self.replaced = self.jvm.Class.forName("org.apache.spark.sql.catalyst.expressions.InheritAnalysisRules")
        self.none, self.n = self.jvm.scala.collection.immutable.List.newBuilder().result(), 0

    @staticmethod
    def _list(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def text(self, e) -> str:
        return self._printed(e)[0]

    def _printed(self, e) -> tuple[str, bool]:
        """The text of e, and whether one of OWN is in it."""
        kind = e.getClass().getSimpleName()
        if kind == "NamedLambdaVariable":
            return f"{e.name()}_{e.exprId().id()}", True
        if kind == "LambdaFunction":
            names = [self.text(a) for a in self._list(e.arguments())]
            return f"{names[0] if len(names) == 1 else f'({", ".join(names)})'} -> {self.text(e.function())}", True
        children = self._list(e.children())
        if not children:
            return e.sql(), False
        if self.replaced.isInstance(e):  # written as the function that was called, not as what replaces it
            inner = [self._printed(x) for x in self._list(e.parameters())]
            return (f"{e.prettyName()}({', '.join(t for t, _ in inner)})", True) if any(own for _, own in inner) else (e.sql(), False)
        inner = [self._printed(x) for x in children]
        if kind == "CreateNamedStruct":
            return f"named_struct({', '.join(t for t, _ in inner)})", True
        if not any(own for _, own in inner):
            return e.sql(), False
        held, stand_ins = {}, self.jvm.java.util.ArrayList()
        for child, (text, _) in zip(children, inner, strict=True):
            of = self.types.DataTypes.IntegerType if child.getClass().getSimpleName() == "LambdaFunction" else child.dataType()
            self.n += 1
            held[f"child_{self.n}_"] = text
            stand_ins.add(self.catalyst.AttributeReference(f"child_{self.n}_", of, True, self.types.Metadata.empty(), self.catalyst.NamedExpression.newExprId(), self.none))
        out = e.withNewChildren(self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(stand_ins).toSeq()).sql()
        for name, text in held.items():
            out = out.replace(name, text)
        return out, True


def sql_of(spark: SparkSession, arguments: str, expression) -> tuple[str, str]:
    """The expression as SQL text over its arguments, and its type."""
    empty = spark.createDataFrame([], arguments)
    value: Column = expression(*[F.col(c) for c in empty.columns])
    df = empty.select(value.alias("r"))
    return _Printer(spark).text(df._jdf.queryExecution().analyzed().expressions().head().child()), df.schema["r"].dataType.simpleString()


def _options(given: str | None) -> layout.LayoutOptions:
    """Layout options of a JSON text of some of their fields."""
    options = json.loads(given) if given else {}
    unknown = set(options) - {f.name for f in fields(layout.LayoutOptions)}
    if unknown:
        raise ValueError(f"unknown layout options: {sorted(unknown)}")
    return layout.LayoutOptions(**options)


class _PageLines:
    """Lines in reading order of a table of observations, as Arrow batches:
    page_lines(TABLE(t) PARTITION BY (page_id) [, options]).

    options is a JSON text of fields of LayoutOptions. Pages that come together are told apart by page_id, so
    a partition may hold a bounded number of pages, such as PARTITION BY (page_id div 1000), which is quicker.
    """

    def __init__(self):
        self.batches, self.options = [], None

    def eval(self, boxes, options=None):
        missing = [c for c in ("page_id", *layout.BOXES) if c not in boxes.schema.names]
        if missing:
            raise ValueError(f"page_lines needs the columns {missing}")
        if self.options is None:
            self.options = _options(options[0].as_py() if options is not None and len(options) else None)
        self.batches.append(boxes.select(["page_id", *layout.BOXES]))
        return iter(())

    def terminate(self):
        if self.batches:
            found = layout.lines_of_pages(pa.Table.from_batches(self.batches), self.options)
            if found.num_rows:
                yield found


def page_lines(page_type: str):
    """The table function for pages whose ids are of a type. (Spark's Arrow table functions have a fixed
    schema: those that analyze their arguments take rows one by one.)"""
    own = type("PageLines", (_PageLines,), {"__doc__": _PageLines.__doc__, "eval": _PageLines.eval})
    return arrow_udtf(own, returnType=f"page_id {page_type}, {layout.LINES}")


#: name: type of the page's id.
TABLE_FUNCTIONS = {"page_lines": "bigint", "page_lines_by_name": "string"}


_bodies: dict[str, tuple[str, str]] = {}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to SQL in this session; returns their names."""
    for name, (arguments, expression) in SCALARS.items():
        if name not in _bodies:
            _bodies[name] = sql_of(spark, arguments, expression)
        body, kind = _bodies[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, kind in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, page_lines(kind))
    return [*SCALARS, *TABLE_FUNCTIONS]
