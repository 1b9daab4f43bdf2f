"""Sessions, tables, and getting this package to the executors."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: dict[str, list[str]] = {}
_paths: dict[int, tuple] = {}
_kept: list[DataFrame] = []


def local(name: str = "webloom", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and for the bench on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="webloom")).resolve() / "webloom_modules.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(target))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none (tests, a laptop) gets one under /tmp; on a cluster that would be another
    folder for every machine, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "/tmp/checkpoints").rstrip("/") + "/webloom"


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which ``clean`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage; the files outlive any executor.

    ``tidy`` has the driver collect its garbage, so that shuffle files which nothing needs any more go; small tables leave few.
    """
    spark = df.sparkSession
    path, schema = place(spark, name), df.schema
    df.write.parquet(path)
    del df
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete a table that ``materialise`` gave and that nothing will read any more."""
    ref, path = _paths.pop(id(df), (None, None))
    if ref is not None and ref() is df:
        _delete(df.sparkSession, path)
        _made[df.sparkSession.sparkContext.applicationId].remove(path)


def keep(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks for the steps that use it; what a lost executor held is worked out again.

    For tables of a fixed number of steps. Rounds, whose lineage would grow, use ``materialise``.
    """
    out = df.persist(StorageLevel.DISK_ONLY)
    _kept.append(out)
    return out


def unkeep() -> None:
    """Drop what ``keep`` holds; results that still need it work it out again."""
    while _kept:
        _kept.pop().unpersist()


def clean(spark: SparkSession) -> None:
    """Delete what queries of this application wrote to the shared folder or keep on disks: once their results are read or written."""
    unkeep()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
    _paths.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
