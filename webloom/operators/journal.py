"""Long jobs that go on where they were stopped.

A journal has a folder of its own, by the job's name, in the shared folder. Each step is a table in it and an entry that says where the table
is, how it is read and what is known of it. An entry appears at once, by a rename, when its table is whole; a step without an entry
never happened. A job that starts again under the same name finds the entries and takes their tables, so it repeats at most one step.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from webloom import session

Facts = dict[str, object]


class Stopped(Exception):
    """A job was stopped between two steps, as its journal was told to."""


class Journal:
    """The journal of job ``run``. ``settings`` are those of its results: a journal that was kept under others is refused.

    ``pause_after`` new steps the next one raises ``Stopped``: so a job can be given a part of the night, and tests can stop it.
    """

    def __init__(self, spark: SparkSession, run: str, settings: Facts | None = None, pause_after: int | None = None) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", run) or run.strip(".") == "":
            raise ValueError(f"not a name for a run: {run!r}")
        self.spark, self.folder, self.left, self.made = spark, f"{session.shared_dir(spark)}/runs/{run}", pause_after, []
        own = json.loads(json.dumps(settings or {}))
        if self._put("settings", own) != own:
            raise ValueError(f"run {run!r} was begun with other settings")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> Facts | None:
        path, system = self._path(f"{name}.json"), self._system()
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, entry: Facts) -> Facts:
        """The entry of a name: the one that is there, or this one, which is seen whole or not at all."""
        if (there := self._read(name)) is not None:
            return there
        system, part = self._system(), self._path(f".{name}-{uuid.uuid4().hex}")
        stream = system.create(part, True)
        stream.write(bytearray(json.dumps(entry, ensure_ascii=True).encode()))
        stream.close()
        if not system.rename(part, self._path(f"{name}.json")):
            system.delete(part, False)
        return self._read(name)

    def step(self, name: str, make: Callable[[], DataFrame], learn: Callable[[DataFrame], Facts] | None = None) -> tuple[DataFrame, Facts]:
        """The table of a step and what ``learn`` found in it: from the journal, or else made, written and entered."""
        entry = self._read(name)
        if entry is None:
            if self.left is not None:
                if self.left <= 0:
                    raise Stopped(name)
                self.left -= 1
            df, table = make(), f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{table}")
            written = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{table}")
            entry = self._put(name, {"table": table, "schema": df.schema.json(), "facts": learn(written) if learn else {}})
            self.made.append(name)
        schema = StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{entry['table']}"), entry["facts"]

    def steps(self) -> list[str]:
        """Names of the entered steps."""
        return sorted(p.removesuffix(".json") for s in self._system().listStatus(self._path("x").getParent()) if (p := s.getPath().getName()).endswith(".json") and p != "settings.json")

    def forget(self) -> None:
        """Delete the journal, once the job's results are read or written."""
        session._delete(self.spark, self.folder)


class Unkept:
    """Steps of a job that isn't to be found again: tables of this session."""

    def step(self, name: str, make: Callable[[], DataFrame], learn: Callable[[DataFrame], Facts] | None = None) -> tuple[DataFrame, Facts]:
        df = session.materialise(make(), name, tidy=False)
        return df, learn(df) if learn else {}
