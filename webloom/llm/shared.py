"""What the operators share: intermediate tables, plain columns, and how many buckets a keyed exchange gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import drop, keep, materialise  # noqa: F401

#: Input bytes (of files, so compressed) for which one more bucket of a keyed exchange is made: a bucket's keys are sorted in memory.
BYTES_PER_BUCKET = 16 << 20
#: A scan that tells of more than this doesn't know its size.
UNKNOWN = 1 << 60


def plain(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns with the wanted types; without a cast where they have them, so equal scans stay equal."""
    have = dict(df.dtypes)
    return df.select(*[F.col(f"`{c}`") if have.get(c) == kind else F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])


def buckets(df: DataFrame) -> int:
    """Buckets for a keyed exchange over ``df``: they follow the bytes that its scans read and the shuffle width."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    known = sum(x for x in sizes if x < UNKNOWN)
    return int(max(parts(df.sparkSession), known // BYTES_PER_BUCKET))


def parts(spark: SparkSession) -> int:
    """The shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
