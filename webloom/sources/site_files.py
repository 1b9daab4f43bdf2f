"""Files of a mirror as a data source: rows (path, content) are written as files below a root, and read back.

The root is a folder that all executors reach (a shared mount, or any URI that Arrow's file systems know). Each file is written
beside its place and moved there, so a reader never sees half of one, and a task that runs again writes the same files.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from webloom import session
from webloom.functions import fixed

NAME = "site_files"
MANIFEST_FILE, SITE_MAP = "_crawl/manifest.json", "index.html"


def _inside(path: str) -> str:
    """``path`` if it stays below the root."""
    if not path or path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"not a path below the root: {path!r}")
    return path


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator) -> _Written:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.root)
        made, n = set(), 0
        for batch in iterator:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if path is None or not content.is_valid:
                    continue
                target = posixpath.join(top, _inside(path))
                folder = posixpath.dirname(target)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, target)
                n += 1
        return _Written(n)


class SiteFiles(DataSource):
    """``df.write.format("site_files").option("root", ...)`` for rows (path string, content binary)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["root"])


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str


class _OrderedWriter(DataSourceArrowWriter):
    """Each task writes its range of lines beside the file; the commit strings the ranges together, a piece at a time, and moves the whole into place."""

    PIECE = 1 << 20

    def __init__(self, root: str, path: str) -> None:
        self.root, self.path, self.mark = root, _inside(path), uuid.uuid4().hex

    def _place(self, name: str) -> tuple:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.root)
        folder = posixpath.dirname(posixpath.join(top, self.path))
        system.create_dir(folder, recursive=True)
        return system, posixpath.join(folder, name)

    def write(self, iterator: Iterator) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId()
        system, part = self._place(f".{self.mark}-{number}-{task.taskAttemptId()}.part")
        with system.open_output_stream(part) as out:
            for batch in iterator:
                out.write("".join(f"{x or ''}\n" for x in batch.column(0).to_pylist()).encode())
        return _Part(number, part)

    def commit(self, messages: list) -> None:
        system, whole = self._place(f".{self.mark}-whole.part")
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        with system.open_output_stream(whole) as out:
            for part in parts:
                with system.open_input_stream(part.path) as source:
                    while piece := source.read(self.PIECE):
                        out.write(piece)
        system.move(whole, self._place(posixpath.basename(self.path))[1])
        self.abort(parts)

    def abort(self, messages: list) -> None:
        for part in messages:
            if part is not None:
                self._place("")[0].delete_file(part.path)


class OrderedFile(DataSource):
    """One text file of lines in the order of the written partitions: ``format("ordered_file")`` with ``root`` and ``path``."""

    @classmethod
    def name(cls) -> str:
        return "ordered_file"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> _OrderedWriter:
        return _OrderedWriter(self.options["root"], self.options["path"])


def store_lines(lines: DataFrame, root: str, path: str = SITE_MAP) -> None:
    """Write ``lines`` (place, line) as one file, in order by ``place``; a null line is an empty one.

    Lines are dealt by ranges of their place and each range is written by a task of its own, so no task has them all.
    """
    session.ship(lines.sparkSession)
    lines.sparkSession.dataSource.register(OrderedFile)
    rows = lines.repartitionByRange("place").sortWithinPartitions("place").select("line")
    rows.write.format(OrderedFile.name()).option("root", root).option("path", path).mode("append").save()


def store(files: DataFrame, root: str) -> None:
    """Write ``files`` (path, content): a text is written as UTF-8.

    Defined cases: rows with a null path or content write nothing; a path that leaves the root fails the job; of rows with one path any
    one is kept whole; an empty table writes nothing; other columns are ignored.
    """
    session.ship(files.sparkSession)
    files.sparkSession.dataSource.register(SiteFiles)
    rows = files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    rows.write.format(NAME).option("root", root).mode("append").save()


def load(spark: SparkSession, root: str, below: str = "") -> DataFrame:
    """(path, content) of the files in a folder below ``root``; unfinished ones are left out, and empty ones, which Spark's reader skips.

    What lies in a folder like ``_crawl`` is read only if ``below`` names that folder.
    """
    start = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(posixpath.join(root, below))
    return files.select(F.substr("path", F.locate(start, F.col("path")) + F.lit(len(start))).alias("path"), "content").where(~F.col("path").rlike(r"(^|/)\.[0-9a-f]{32}\.part$"))


def raw_path(key) -> F.Column:
    """Where a page's snapshot lies."""
    return F.concat(F.lit(f"{fixed.RAW_DIR}/"), F.sha1(key), F.lit(".html"))


def store_snapshots(fetched: DataFrame, root: str) -> None:
    """The fetched html of each ``key``, as it came."""
    store(fetched.select(raw_path(F.col("key")).alias("path"), F.col("html").alias("content")), root)


def snapshots(records: DataFrame, root: str) -> DataFrame:
    """(key, html) of the records' stored snapshots; a record whose ``raw`` file is missing has none, like one that is empty."""
    files = load(records.sparkSession, root, fixed.RAW_DIR)
    return records.where("raw <> ''").select("key", "raw").join(files, F.col("raw") == F.col("path")).select("key", F.col("content").cast("string").alias("html"))


def discard_snapshots(spark: SparkSession, root: str) -> None:
    """Delete the snapshots, once pages are rewritten and nothing will rewrite them again."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(posixpath.join(root, fixed.RAW_DIR))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def store_mirror(root: str, pages: DataFrame, sheets: DataFrame | None = None, assets: DataFrame | None = None, manifest: DataFrame | None = None, site_map: DataFrame | None = None) -> None:
    """A mirror's files: rewritten ``pages`` (path, html), ``sheets`` (path, css), ``assets`` (path, content), one ``manifest`` (value) and the ``site_map`` (place, line)."""
    store(pages.select("path", F.col("html").alias("content")), root)
    if sheets is not None:
        store(sheets.select("path", F.col("css").alias("content")), root)
    if assets is not None:
        store(assets, root)
    if manifest is not None:
        store(manifest.select(F.lit(MANIFEST_FILE).alias("path"), F.col("value").alias("content")), root)
    if site_map is not None:
        store_lines(site_map, root)
