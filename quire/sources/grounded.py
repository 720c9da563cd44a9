"""Grounded answers as a Spark data source: ``spark.read.format("grounded").load(folder)`` (UDF-04).

A folder holds files of JSON lines, one answer of a reader's model a page: doc_id, page_index, width, height, answer. ``write_answers``
lays it out by ranges of doc_id and notes the range of each file; a filter on doc_id then leaves out files
that can't hold it before any is opened. Files go to tasks by size. A page whose answer the backend can't
read is a row with its error, as any other page's blocks are rows.

A backend is a callable from an answer to items (bbox, text, label, reason); subclass ``GroundedSource`` with another ``name`` and
``backend`` to plug one in, and give the class to ``register``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quire.sources.documents import grounded_items, placed_boxes

RANGES = "_ranges.json"  # a leading underscore hides it from Spark's own readers
RAW = pa.schema([
    ("doc_id", pa.int64()), ("page_index", pa.int64()), ("item", pa.int64()), ("width", pa.float64()), ("height", pa.float64()),
    ("bbox", pa.list_(pa.float64())), ("text", pa.string()), ("label", pa.string()), ("reason", pa.string()), ("error", pa.string()),
])
RAW_DDL = "doc_id long, page_index long, item long, width double, height double, bbox array<double>, text string, label string, reason string, error string"


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: list[str]


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def may_hold(low, high, filters: list[Filter]) -> bool:
    """Whether a file with doc_ids from low to high can have a row that passes; a file without ids has null bounds."""
    for f in filters:
        if isinstance(f, In):
            ok = low is not None and any(v is not None and low <= v <= high for v in f.value)
        elif low is None or f.value is None:
            ok = low is None and f.value is None and isinstance(f, EqualNullSafe)
        elif isinstance(f, (EqualTo, EqualNullSafe)):
            ok = low <= f.value <= high
        elif isinstance(f, GreaterThan):
            ok = high > f.value
        elif isinstance(f, GreaterThanOrEqual):
            ok = high >= f.value
        elif isinstance(f, LessThan):
            ok = low < f.value
        else:
            ok = low <= f.value
        if not ok:
            return False
    return True


class GroundedReader(DataSourceReader):
    USED = (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)

    def __init__(self, path: str, task_bytes: int, backend: Callable[[str], list[dict]]) -> None:
        self.path, self.task_bytes, self.backend = path, task_bytes, backend
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on doc_id choose files; Spark applies all of them to rows as well."""
        self.filters = [f for f in filters if isinstance(f, self.USED) and f.attribute == ("doc_id",)]
        yield from filters

    def partitions(self) -> list[Files]:
        where, root = _folder(self.path)
        found = [f for f in where.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        ranges = {}
        if where.get_file_info(f"{root}/{RANGES}").is_file:
            with where.open_input_stream(f"{root}/{RANGES}") as s:
                ranges = {r["file"]: r for r in map(json.loads, s.read().decode().splitlines())}
        out, size = [], 0
        for f in sorted(found, key=lambda f: f.path):
            r = ranges.get(f.base_name)
            if r is not None and not may_hold(r["low"], r["high"], self.filters):
                continue
            if not out or size + f.size > self.task_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = _folder(self.path)
        rows: list[dict] = []
        for path in partition.paths:
            with where.open_input_stream(path) as s:
                for line in _lines(s):
                    rows += self._page(json.loads(line))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=RAW)
                        rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=RAW)

    def _page(self, page: dict) -> list[dict]:
        at = {k: page.get(k) for k in ("doc_id", "page_index")} | {k: None if page.get(k) is None else float(page[k]) for k in ("width", "height")}
        try:
            return [at | {"item": i} | x for i, x in enumerate(self.backend(page.get("answer") or ""))]
        except Exception as e:  # a failed page is a row: it must not fail the others
            return [at | {"error": f"{type(e).__name__}: {e}"}]


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while part := stream.read(size):
        *whole, rest = (rest + part).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


class GroundedSource(DataSource):
    """Options: path, and ``task_bytes`` (64 MB) of files a task."""

    backend: Callable[[str], list[dict]] = staticmethod(grounded_items)

    @classmethod
    def name(cls) -> str:
        return "grounded"

    def schema(self) -> str:
        return RAW_DDL

    def reader(self, schema) -> GroundedReader:
        return GroundedReader(self.options["path"], int(self.options.get("task_bytes", 64 << 20)), type(self).backend)


def register(spark: SparkSession, source: type[DataSource] = GroundedSource) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def read_grounded(spark: SparkSession, path: str, where: str | None = None, source: type[DataSource] = GroundedSource) -> DataFrame:
    """Blocks of a folder's answers, in fractions of their page, and the reason where an item is dropped."""
    register(spark, source)
    rows = spark.read.format(source.name()).load(path)
    return placed_boxes(rows.where(where) if where else rows, "error")


def write_answers(answers: DataFrame, path: str, files: int | None = None) -> None:
    """Answers in files by ranges of doc_id, with the range of each file noted (a line a file)."""
    order = ["doc_id", "page_index"]
    dealt = answers.repartitionByRange(files, *order) if files else answers.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.json(path)
    spark = answers.sparkSession
    written = spark.read.schema("doc_id long").json(path)
    ranges = written.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()
    where, root = _folder(path)
    with where.open_output_stream(f"{root}/{RANGES}") as s:
        s.write("\n".join(json.dumps(r.asDict()) for r in ranges).encode())
