"""What a fetcher stored, as archives of many pages: a data source that a crawl takes in place of a table.

An archive is a file of JSON lines. Its first line is a head: how many pages it has, and the smallest and the greatest of their keys. The writer
deals pages by ranges of their keys, so a reader that is asked for some keys opens only the heads of the other archives. What
Spark pushes (equality and lists on ``key`` and ``status``, beginnings of keys, nulls) is applied while lines are read; columns that nobody asks for
aren't taken from the lines. Any other fetcher is a data source of these columns: ``fetched(spark, format, ...)`` reads it.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from webloom import session

NAME, SUFFIX = "page_archives", ".pages.jsonl"
#: What a fetcher says of each URL that it was asked for.
COLUMNS = {"key": "string", "url": "string", "html": "string", "title": "string", "status": "int", "content_type": "string", "error": "string"}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())
#: Characters of pages that a batch holds, or one page; bytes of an archive that are read at a time.
BATCH, READ = 8 << 20, 1 << 20


@dataclass
class _Archive(InputPartition):
    path: str


@dataclass
class _Stored(WriterCommitMessage):
    path: str


def _lines(system, path: str) -> Iterator[bytes]:
    rest = b""
    with system.open_input_stream(path) as source:
        while piece := source.read(READ):
            *whole, rest = (rest + piece).split(b"\n")
            yield from whole
    if rest:
        yield rest


def _test(f: Filter) -> tuple[str, Callable[[object], bool]] | None:
    """The column of a filter and what it asks of a value, if it can be applied here."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in COLUMNS:
        return None
    name = f.attribute[0]
    if isinstance(f, EqualTo):
        return name, lambda v: v is not None and v == f.value
    if isinstance(f, In):
        wanted = set(f.value)
        return name, lambda v: v is not None and v in wanted
    if isinstance(f, IsNull):
        return name, lambda v: v is None
    if isinstance(f, IsNotNull):
        return name, lambda v: v is not None
    if isinstance(f, StringStartsWith):
        return name, lambda v: v is not None and v.startswith(f.value)
    return None


def _meets(f: Filter, low: str | None, high: str | None) -> bool:
    """Whether keys between two ones can pass a filter; rows without a key lie outside all bounds."""
    if f.attribute[0] != "key" or isinstance(f, IsNull):
        return True
    if low is None:
        return False
    if isinstance(f, EqualTo):
        return low <= f.value <= high
    if isinstance(f, In):
        return any(low <= v <= high for v in f.value if v is not None)
    if isinstance(f, StringStartsWith):
        return low[: len(f.value)] <= f.value <= high[: len(f.value)]
    return True


class _Reader(DataSourceReader):
    def __init__(self, root: str, schema: StructType) -> None:
        self.root, self.names, self.filters = root, schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[_Archive]:
        """One for each archive that can have a row; no more than their heads are read."""
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        out = []
        for path in sorted(x.path for x in found if x.is_file and x.path.endswith(SUFFIX) and not x.base_name.startswith(".")):
            head = json.loads(next(_lines(system, path)))
            if head["pages"] and all(_meets(f, head["low"], head["high"]) or head["without"] for f in self.filters):
                out.append(_Archive(path))
        return out

    def read(self, partition: _Archive | None) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        if partition is None:  # no archive has a row
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        tests = [_test(f) for f in self.filters]
        kinds = pa.schema([(n, pa.int32() if COLUMNS[n] == "int" else pa.string()) for n in self.names])
        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.field(n).type) for n in self.names], schema=kinds)
        lines = _lines(system, partition.path)
        next(lines)
        for line in lines:
            row = json.loads(line)
            if all(test(row.get(name)) for name, test in tests):
                rows.append({n: row.get(n) for n in self.names})
                held += len(line)
                if held >= BATCH:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str, names: list[str]) -> None:
        self.root, self.names, self.run = root, names, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Stored:
        """The archive of a task's pages, put into place when it is whole."""
        from pyarrow import fs
        from pyspark import TaskContext

        system, top = fs.FileSystem.from_uri(self.root)
        system.create_dir(top, recursive=True)
        task = TaskContext.get()
        name = f"{self.run}-{task.partitionId():06d}"
        body = posixpath.join(top, f".{name}-{task.taskAttemptId()}.body")
        low = high = None
        pages = without = 0
        with system.open_output_stream(body) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    key = row["key"]
                    pages += 1
                    if key is None:
                        without += 1
                    else:
                        low, high = key if low is None else min(low, key), key if high is None else max(high, key)
                    out.write(json.dumps(row, ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n")
        part = posixpath.join(top, f".{name}-{task.taskAttemptId()}.part")
        with system.open_output_stream(part) as out, system.open_input_stream(body) as source:
            out.write(json.dumps({"pages": pages, "without": without, "low": low, "high": high}).encode() + b"\n")
            while piece := source.read(READ):
                out.write(piece)
        target = posixpath.join(top, name + SUFFIX)
        system.move(part, target)
        system.delete_file(body)
        return _Stored(target)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        for one in messages:
            if one is not None:
                fs.FileSystem.from_uri(self.root)[0].delete_file(one.path)


class PageArchives(DataSource):
    """``format("page_archives")`` with ``root``, a folder that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["root"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["root"], schema.names)


def _ready(spark: SparkSession) -> None:
    session.ship(spark)
    spark.dataSource.register(PageArchives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def store_pages(fetched: DataFrame, root: str, archives: int | None = None) -> None:
    """Add ``fetched`` to the archives below ``root``, dealt by ranges of their keys.

    Columns that are missing are null; others are left out; an empty table adds archives without pages.
    """
    _ready(fetched.sparkSession)
    rows = fetched.select(*[(F.col(n) if n in fetched.columns else F.lit(None)).cast(kind).alias(n) for n, kind in COLUMNS.items()])
    dealt = rows.repartitionByRange(archives, "key") if archives else rows.repartitionByRange("key")
    dealt.write.format(NAME).option("root", root).mode("append").save()


def fetched(spark: SparkSession, form: str = NAME, columns: list[str] | None = None, **options: str) -> DataFrame:
    """What a fetcher gave, from a data source by its name: one of ``COLUMNS``, or of those of them that ``columns`` names.

    ``page_archives`` with ``root`` is the one that comes with this package; others are registered by who brings them.
    """
    _ready(spark)
    kept = {n: kind for n, kind in COLUMNS.items() if columns is None or n in columns}
    reader = spark.read.format(form).schema(", ".join(f"{n} {kind}" for n, kind in kept.items()))
    return reader.options(**options).load()
