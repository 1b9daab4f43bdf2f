"""Search for a piece of a page's title or URL by an index, so that what is read follows what is found.

Every run of three characters of a page's text has a posting, dealt by the run's hash; how often each run occurs is counted beside them. A
term is looked up by its rarest run: one bucket of postings is read, then the buckets of the pages that it names, whose texts
decide. Terms of less than three characters have no run and are held against all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import session
from webloom.functions import html as H

GRAM = 3
#: Buckets of the postings and of the texts.
BUCKETS = 256


def _text(title: Column, url: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(url, F.lit(""))))


def _grams(text: Column) -> Column:
    """The distinct runs of a text."""
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda k: F.substring(text, k, F.lit(GRAM)))
    return F.array_distinct(F.when(F.length(text) >= GRAM, runs).otherwise(F.array().cast("array<string>")))


def _bucket(x: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int").alias("bucket")


class SearchIndex:
    """An index below ``path``; ``build`` writes one, and one that is there can be opened again."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    @classmethod
    def build(cls, pages: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> SearchIndex:
        """Index ``pages`` (page_id, url, html, and ``title`` if there is one). A null title or URL is empty; rows that repeat are found as often."""
        spark = pages.sparkSession
        self = cls(spark, path or session.place(spark, "search"), buckets)
        title = F.col("title") if "title" in pages.columns else H.title(F.coalesce("html", F.lit("")))
        rows = pages.select("page_id", "url", _text(title, F.col("url")).alias("text")).withColumn("bucket", _bucket(F.col("page_id"), buckets))
        rows.repartition("bucket").sortWithinPartitions("bucket", "page_id").write.partitionBy("bucket").parquet(f"{self.path}/texts")
        runs = self._texts().select("page_id", F.explode(_grams(F.col("text"))).alias("gram")).distinct().withColumn("bucket", _bucket(F.col("gram"), buckets))
        # Sorted by run, so that the row groups of a bucket that a run isn't in are skipped; a frequent run is spread over the files of its bucket.
        dealt = runs.repartition("bucket", F.pmod(F.xxhash64("page_id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "page_id")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/postings")
        counts = self._postings().groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.path}/counts")
        return self

    def _texts(self) -> DataFrame:
        return self.spark.read.schema("page_id bigint, url string, text string, bucket int").parquet(f"{self.path}/texts")

    def _postings(self) -> DataFrame:
        return self.spark.read.schema("page_id bigint, gram string, bucket int").parquet(f"{self.path}/postings")

    def _rarest(self, term: str) -> tuple[str, int] | None:
        """The run of a term that the fewest pages have, and its bucket; None if a run is in no page."""
        grams = sorted({term[k : k + GRAM] for k in range(len(term) - GRAM + 1)})
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").withColumn("bucket", _bucket(F.col("gram"), self.buckets)).collect()
        counts = self.spark.read.schema("gram string, n bigint, bucket int").parquet(f"{self.path}/counts")
        have = {r.gram: r.n for r in counts.where(F.col("bucket").isin([r.bucket for r in asked]) & F.col("gram").isin(grams)).collect()}  # a row for each run of the term
        if len(have) < len(grams):
            return None
        gram = min(grams, key=lambda g: (have[g], g))
        return gram, next(r.bucket for r in asked if r.gram == gram)

    def candidates(self, term: str) -> DataFrame | None:
        """(page_id) of the pages that have the term's rarest run; None for a term that has no run."""
        if len(term) < GRAM:
            return None
        found = self._rarest(term)
        if found is None:
            return self._postings().select("page_id").limit(0)
        return self._postings().where((F.col("bucket") == found[1]) & (F.col("gram") == found[0])).select("page_id")

    def find(self, term: str) -> DataFrame:
        """(page_id, url) of the pages whose title or URL has ``term``, whatever its case."""
        term = term.lower()
        texts, near = self._texts(), self.candidates(term)
        if near is not None:
            touched = [r[0] for r in near.select(_bucket(F.col("page_id"), self.buckets)).distinct().collect()]  # as many as buckets
            texts = texts.where(F.col("bucket").isin(touched)).join(near, "page_id", "left_semi")
        return texts.where(F.contains("text", F.lit(term))).select("page_id", "url")
