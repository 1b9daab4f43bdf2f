"""Archives of pages: all rows come back, filters are pushed and open no other archive, a crawl reads them like a table."""

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from webloom.functions.scope import Scope
from webloom.operators import mirror
from webloom.sources import archives

ROWS = [(f"https://h/{k:04d}", f"https://h/{k:04d}", "é\n\"<p> " * (k % 5), None if k % 3 else "t", None if k % 7 == 0 else 200 + k % 4, "text/html", "boom" if k % 11 == 0 else None) for k in range(300)] + [(None, None, None, None, None, None, None)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, archives.SCHEMA)
    archives.store_pages(df.withColumn("more", F.lit(1)), str(tmp_path), 6)
    back = archives.fetched(spark, root=str(tmp_path))
    assert back.columns == list(archives.COLUMNS) and rows(back) == sorted(ROWS, key=str)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(archives.SUFFIX) and not p.name.endswith(".crc")] == []
    archives.store_pages(df.limit(0), str(tmp_path))
    archives.store_pages(spark.createDataFrame([("z", "new")], "key string, html string"), str(tmp_path), 1)
    assert archives.fetched(spark, root=str(tmp_path)).count() == len(ROWS) + 1
    assert archives.fetched(spark, root=f"{tmp_path}/none").count() == 0
    some = archives.fetched(spark, columns=["key", "status"], root=str(tmp_path))
    assert some.columns == ["key", "status"] and some.where("status = 201").count() == sum(r[4] == 201 for r in ROWS)


def test_pushed_filters(spark, tmp_path):
    df = spark.createDataFrame(ROWS, archives.SCHEMA)
    archives.store_pages(df, str(tmp_path), 6)
    back = archives.fetched(spark, root=str(tmp_path))
    for where in ("key = 'https://h/0007'", "key IN ('https://h/0007', 'https://h/0290', 'x')", "key LIKE 'https://h/00%'", "status = 203 AND error IS NULL", "status IN (200, 202)", "error IS NOT NULL", "key IS NULL", "status IS NULL", "status > 201", "key = 'https://h/0001' OR status = 200", "key > 'https://h/0200'"):
        assert rows(back.where(where)) == rows(df.where(where)), where
    plan = back.where("status = 203")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan" in plan, plan  # Spark has nothing left to filter
    reader = archives._Reader(str(tmp_path), df.schema)
    assert len(reader.partitions()) == 6
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    assert list(reader.pushFilters([EqualTo(("key",), "https://h/0007")])) == [] and len(reader.partitions()) <= 2  # one more has the row without a key
    other = archives._Reader(str(tmp_path), df.schema)
    assert list(other.pushFilters([StringStartsWith(("key",), "https://h/02")])) == [] and len(other.partitions()) <= 4


def other_fetcher():
    """A fetcher of someone else's, which travels to the workers by value."""

    class Reader(DataSourceReader):
        def __init__(self, host):
            self.host = host

        def read(self, partition):
            yield (f"https://{self.host}/a", f"https://{self.host}/a", "<a href='/b'>b</a>", "t", 200, "text/html", None)

    class Other(DataSource):
        @classmethod
        def name(cls):
            return "other_fetcher"

        def reader(self, schema):
            return Reader(self.options["host"])

    return Other


def test_crawls_from_sources(spark, tmp_path):
    """The same records from a table, from archives, and from a source that is no part of the package."""
    html = lambda *xs: "".join(f'<a href="/{x}">x</a>' for x in xs)
    df = spark.createDataFrame([(f"https://h/{k}", f"https://h/{k}", html(*to), "t", 200, "text/html", None) for k, to in (("a", "bc"), ("b", "d"), ("c", ""))], archives.SCHEMA)
    archives.store_pages(df, str(tmp_path), 2)
    seeds, scope = spark.createDataFrame([("https://h/a", 0)], "key string, seq bigint"), Scope(max_depth=3, max_pages=0)
    of = lambda source: sorted((r.key, r.depth, r.error) for r in mirror.crawl(source, seeds, scope).records.collect())
    assert of(archives.fetched(spark, root=str(tmp_path))) == of(df) == [("https://h/a", 0, None), ("https://h/b", 1, None), ("https://h/c", 1, None), ("https://h/d", 2, "no response")]
    spark.dataSource.register(other_fetcher())
    assert of(archives.fetched(spark, "other_fetcher", host="h")) == [("https://h/a", 0, None), ("https://h/b", 1, "no response")]
