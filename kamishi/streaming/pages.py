"""Streams of whole pages. A page is one row, so nothing is kept between rows and no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ctc
from ..functions.dates import parse_date, parse_time
from ..functions.numbers import parse_amount
from ..functions.text import normalize_all

RECEIPT_PAGE = "doc_id long, lines array<string>"


def read_pages(spark: SparkSession, path: str, schema: str = RECEIPT_PAGE) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def line_facts(lines: Column) -> Column:
    """array<struct<norm, date, time, amount>> of a page's lines."""
    fact = lambda n: F.struct(n.alias("norm"), parse_date(n, True).alias("date"), parse_time(n, True).alias("time"), parse_amount(n, True).alias("amount"))
    return F.transform(F.transform(lines, normalize_all), fact)


def with_facts(pages: DataFrame) -> DataFrame:
    return pages.withColumn("facts", line_facts(F.col("lines")))


def with_decoded(pages: DataFrame, vocabulary: Column, blank: int = 0) -> DataFrame:
    """pages (…, logits) with the CTC reading of each."""
    return pages.withColumn("decoded", ctc.decode_logits(F.col("logits"), vocabulary, blank))


def per_batch(pages: DataFrame, analyze: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], checkpoint: str):
    """Run a batch operator (layout, tables, receipts) on every micro-batch: pages arrive whole, so the
    batch holds all that the operator needs."""
    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: write(analyze(batch))).start()
