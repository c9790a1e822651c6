"""Files of pages as Spark data sources: observations read with pushed filters, pages written all or none.

`register(spark)` makes two formats known:

* `observations` reads files of recognized pages. A line is a page's JSON text `{"page_id": 1, "boxes":
  [{"text": ..., "x": ..., "y": ..., "width": ..., "height": ..., "confidence": ...}, ...]}`. Files are dealt
  into partitions by size on the driver; comparisons of page_id and confidence with constants are answered
  here: pages and boxes that fail never become rows. A line that is no such page is an error.
* `page_files` writes rows (page_id, content) as one file per page, named by the page and a suffix. The driver
  makes a staging folder for the job, below which a task writes; commit moves each task's folder to its place,
  abort deletes the staging folder. A failed job, task or attempt leaves nothing behind: one that outlives its
  job (Spark aborts before killed tasks have ended) never makes the staging folder anew, and stops.

Paths are those of pyarrow.fs (local, or a store by its URI), the same for the driver and the executors.
"""

from __future__ import annotations

import json
import operator
import os
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

SCHEMA = "page_id long, obs_id int, text string, x double, y double, width double, height double, confidence double"
ARROW = pa.schema([("page_id", pa.int64()), ("obs_id", pa.int32()), ("text", pa.string()), *((c, pa.float64()) for c in ("x", "y", "width", "height", "confidence"))])
#: Mark in a staging folder while its job may still commit.
OPEN = "_open"
#: Bytes of files that a partition takes, and rows of a batch.
PARTITION_BYTES, BATCH_ROWS = 64 << 20, 10_000
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda v, among: v in among}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class ObservationReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes
        self.tests: dict[str, list[tuple[str, object]]] = {"page_id": [], "confidence": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if type(f) in COMPARE and len(f.attribute) == 1 else None
            if column in self.tests and f.value is not None:
                self.tests[column].append((type(f).__name__, tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _passes(self, column: str, value) -> bool:
        compare = {k.__name__: c for k, c in COMPARE.items()}
        return all(value is not None and compare[name](value, wanted) for name, wanted in self.tests[column])

    def partitions(self) -> list[Files]:
        store, root = _opened(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f for f in found if f.is_file and not posixpath.basename(f.path).startswith(("_", "."))), key=lambda f: f.path)
        parts, held, size = [], [], 0
        for f in files:
            if held and size + f.size > self.partition_bytes:
                parts.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*parts, Files(tuple(held))] if held else parts or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        rows: list[tuple] = []
        for path in partition.paths:
            with store.open_input_stream(path) as raw:
                for number, line in enumerate(_lines(raw), 1):
                    if not line.strip():
                        continue
                    try:
                        page = json.loads(line)
                        boxes, page_id = page["boxes"], page["page_id"]
                    except (ValueError, KeyError, TypeError) as e:
                        raise ValueError(f"{path}, line {number}: no page") from e
                    if not self._passes("page_id", page_id):
                        continue
                    for k, b in enumerate(boxes):
                        sure = b.get("confidence", 1.0)
                        if self._passes("confidence", sure):
                            rows.append((page_id, k, b.get("text"), b["x"], b["y"], b["width"], b["height"], sure))
                    if len(rows) >= BATCH_ROWS:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _lines(raw) -> Iterator[bytes]:
    """Lines of a stream, read piece by piece."""
    rest = b""
    while piece := raw.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class Observations(DataSource):
    """spark.read.format("observations").load(path); option partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObservationReader:
        return ObservationReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    pages: int


class PageWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path, suffix, overwrite
        self.job = uuid.uuid4().hex

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        store, root = _opened(self.path)
        return store, root, f"{root}/_staging-{self.job}"

    def begin(self) -> PageWriter:
        """Once, on the driver: the job's staging folder with the mark that the job is open."""
        store, _, staging = self._staging()
        store.create_dir(staging)
        store.open_output_stream(f"{staging}/{OPEN}").close()
        return self

    def _check_open(self, store: fs.FileSystem, staging: str) -> None:
        if store.get_file_info(f"{staging}/{OPEN}").type == fs.FileType.NotFound:
            self._clean()  # where a store makes missing folders by itself
            raise RuntimeError("page_files: the job has ended")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, staging = self._staging()
        name, pages = f"part-{uuid.uuid4().hex}", 0
        for batch in iterator:
            for page, content in zip(batch.column("page_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                self._check_open(store, staging)
                if not pages:
                    store.create_dir(f"{staging}/{name}", recursive=False)
                with store.open_output_stream(f"{staging}/{name}/{quote(str(page), safe='')}.{self.suffix}") as out:
                    out.write((content or "").encode())
                pages += 1
        self._check_open(store, staging)
        return Written(name if pages else None, pages)

    def commit(self, messages: list[Written | None]) -> None:
        store, root, staging = self._staging()
        if self.overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            for old in store.get_file_info(fs.FileSelector(root)):
                if not posixpath.basename(old.path).startswith("_staging-"):
                    store.delete_dir(old.path) if old.type == fs.FileType.Directory else store.delete_file(old.path)
        store.create_dir(root)
        for m in messages:
            if m is not None and m.folder:
                store.move(f"{staging}/{m.folder}", f"{root}/{m.folder}")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Whatever is left of the job, attempts that were not committed included. Moved away first: who still
        writes finds no folder, and adds nothing to one that is being deleted."""
        store, root, staging = self._staging()
        if store.get_file_info(staging).type == fs.FileType.Directory:
            ended = f"{root}/_staging-{uuid.uuid4().hex}"
            try:
                store.move(staging, ended)
            except (OSError, NotImplementedError):  # a store that moves no folders
                ended = staging
            store.delete_dir(ended)


class PageFiles(DataSource):
    """df.write.format("page_files").option("suffix", "md").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        missing = {"page_id", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"page_files needs the columns {sorted(missing)}")
        return PageWriter(self.options["path"], self.options.get("suffix", "md"), overwrite).begin()


def register(spark: SparkSession) -> None:
    """Make both formats known in this session, and have Spark offer filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Observations, PageFiles):
        spark.dataSource.register(source)
