"""What the training-data operators share: tables, the shared folder, expressions."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of a word: the space and the controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may go without: it gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="kamishi-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kamishi/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    return _write(df, name)[0]


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: int):
    """Jobs run inside hand Python batches of at most about size bytes; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables in the shared folder that belong to one call; those no longer read are deleted."""

    def __init__(self):
        self.paths: list[tuple[DataFrame, str]] = []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.paths.append((out, path))
        return out

    def folders(self, df: DataFrame, name: str, by: str, n: int) -> list[str]:
        """Write df in folders of its values 0 .. n - 1 of column by, which goes; their paths, for tasks that read them with pyarrow."""
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/kamishi/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(by).parquet(path)
        self.paths.append((df, path))
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()
        where = "file://" + where.removeprefix("file:") if where.startswith("file:/") and not where.startswith("file://") else where
        return [f"{where}/{by}={i}" for i in range(n)]

    def _delete(self, gone: Callable[[DataFrame], bool]) -> None:
        for df, path in self.paths:
            if gone(df):
                spark = df.sparkSession
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = [(df, p) for df, p in self.paths if not gone(df)]

    def drop(self, *tables: DataFrame) -> None:
        self._delete(lambda df: any(df is t for t in tables))

    def discard(self, *keep: DataFrame) -> None:
        """Delete all tables but those of keep."""
        self._delete(lambda df: not any(df is k for k in keep))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Maximal runs outside the white-space class; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that name a row by its id and text, never null; rows equal in both share it."""
    return [F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(F.lit("row"), text, doc_id).alias("r2")]


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one narrow aggregate that sizes the work units."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
