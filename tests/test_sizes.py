"""Sizes that pass a long, and those halfway between two decimals."""

from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.operators import report
from webloom.plans.registry import QUERIES


def test_totals_beyond_a_long(spark, tmp_path):
    assets = spark.createDataFrame([((1 << 63) - 1, None), ((1 << 63) - 1, "boom"), (3, None)], "size bigint, error string")
    assert tuple(report.asset_totals(assets).first()) == (2, (1 << 64) + 1)
    assert tuple(report.asset_totals(assets.limit(0)).first()) == (0, 0)
    spark.range(3).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(9e15).alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert tuple(QUERIES["asset_totals"](spark, str(tmp_path)).first()) == (2, 27 * 10**18)


def test_decimals_as_in_sql(spark):
    sizes = [k << s for s in (8, 18, 28, 38, 48) for k in (4, 5, 7, 9, 4095)] + [1024**k * 1024 - 1 for k in range(5)] + [(1 << 53) + 1, int(8.35 * (1 << 50)), (1 << 62) + (1 << 48), None]

    def told(n: int) -> str:
        for k, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB")):
            if n < 1024 ** (k + 1) or unit == "PB":
                return f"{n / 1024**k:.{min(k, 1)}f} {unit}"

    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    got = df.select("n", H.human_bytes(F.col("n")), report.megabytes(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(n, None, None) if n is None else (n, told(n), f"{n / (1 << 20):.1f} MB") for n in sizes]
