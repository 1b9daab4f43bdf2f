"""A whole crawl over the pages table and the links that they really have: robots, walls, budget, records, summary, rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import fixed, html as H, url as U
from webloom.functions.scope import Scope
from webloom.operators import links as L, mirror
from webloom.plans.base import SQL_LINKS, pages, query, sql_canonical, sql_page_like, sql_path

#: Every host blocks what begins with ``/t``; fetches fail, meet a wall or give a file by what their id leaves of 11.
BLOCKED = "/t"
_TIMEOUT, _WALL, _FILE = 3, 5, 7
_WALL_PAGE = "<p>Please slow down</p>"
SCOPE = Scope(max_depth=1, max_pages=0)


def fetched(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    i = F.col("page_id") % 11
    rows = (pages(spark, sf_dir) if source is None else source).select("page_id", U.canonical(F.col("url")).alias("c"), "html")
    rows = rows.select("page_id", F.col("c.key").alias("key"), F.col("c.fetch_url").alias("url"), "html").where("key IS NOT NULL")
    first = L.first_seen(rows, ["page_id"])
    blank = F.lit(None).cast("string")
    return first.select(
        "page_id", "key", "url", F.when(i == _TIMEOUT, "").when(i == _WALL, _WALL_PAGE).otherwise(F.col("html")).alias("html"), F.when(i.isin(_TIMEOUT, _WALL), "").otherwise(H.title(F.col("html"))).alias("title"),
        F.when(i == _WALL, 429).when(i != _TIMEOUT, 200).alias("status"), F.when(i == _FILE, "application/pdf").otherwise("text/html").alias("content_type"), F.when(i == _TIMEOUT, "timeout").otherwise(blank).alias("error"),
    )


def crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, mirror.Mirror]:
    """All pages are seeds; what they link to is met at depth 1, where the store has nothing."""
    got = fetched(spark, sf_dir)
    origins = L.page_links(pages(spark, sf_dir)).select(U.origin(F.col("key")).alias("origin")).union(got.select(U.origin(F.col("key")))).distinct()
    rules = origins.select("origin", F.lit(0).alias("seq"), F.lit(False).alias("allow"), F.lit(BLOCKED).alias("prefix"))
    return got, mirror.crawl(got, got.select("key", F.col("page_id").alias("seq")), SCOPE, rules)


_SEEN = SQL_LINKS + f""", {sql_canonical("canon", "links", "raw", "url")}, src AS (SELECT page_id, url AS raw, NULL AS base, html FROM pages), {sql_canonical("page", "src")},
store AS (SELECT key, min(page_id) AS page_id, arg_min(fetch_url, page_id) AS url, arg_min(html, page_id) AS html FROM page WHERE key IS NOT NULL GROUP BY key),
start AS (SELECT *, {sql_path("key")} LIKE '{BLOCKED}%' AS shut FROM store),
kind AS (SELECT *, CASE WHEN shut THEN 'blocked' WHEN page_id % 11 = {_TIMEOUT} THEN 'timeout' WHEN page_id % 11 = {_WALL} THEN 'wall' WHEN page_id % 11 = {_FILE} THEN 'file' ELSE 'page' END AS k FROM start),
met AS (SELECT DISTINCT c.key FROM canon c JOIN kind s ON s.page_id = c.page_id AND s.k = 'page' WHERE c.key IS NOT NULL AND {sql_page_like("c.fetch_url")} AND c.key NOT IN (SELECT key FROM store)),
rec AS (SELECT key, 0 AS depth, CASE k WHEN 'blocked' THEN '{fixed.ROBOTS_ERROR}' WHEN 'timeout' THEN 'timeout' WHEN 'wall' THEN 'challenge: server rate-limit (http 429)' END AS error, CASE WHEN k = 'page' THEN length(html) ELSE 0 END AS bytes FROM kind WHERE k <> 'file'
  UNION ALL SELECT key, 1, CASE WHEN {sql_path("key")} LIKE '{BLOCKED}%' THEN '{fixed.ROBOTS_ERROR}' ELSE '{mirror.NO_RESPONSE}' END, 0 FROM met)"""


@query("WITH " + _SEEN + " SELECT key, CAST(depth AS INT) AS depth, error, CAST(bytes AS BIGINT) AS bytes FROM rec")
def crawl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page that a crawl over the extracted links met: its depth, and its size or what kept it out."""
    return crawled(spark, sf_dir)[1].records.select("key", "depth", "error", "bytes")


@query(
    "WITH " + _SEEN + f""" SELECT count(*) FILTER (error IS NULL) AS pages, count(*) FILTER (error IS NOT NULL AND error <> '{fixed.ROBOTS_ERROR}') AS failed, count(*) FILTER (error = '{fixed.ROBOTS_ERROR}') AS blocked,
  count(*) FILTER (error LIKE 'challenge: %') AS walled, coalesce(max(depth) FILTER (error IS NULL), 0) AS max_depth, count(*) FILTER (error LIKE 'challenge: %') AS walls_hit, CAST(0 AS BIGINT) AS cleared,
  (SELECT count(*) FROM kind WHERE k = 'file') AS assets, CAST(0 AS BIGINT) AS asset_bytes, CAST(0 AS BIGINT) AS not_crawled FROM rec"""
)
def mirror_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole crawl's figures in one row."""
    got, done = crawled(spark, sf_dir)
    return mirror.summary(done, got).drop("throttled", "failures", "first_failures")


@query("WITH " + _SEEN + f" SELECT url, error FROM (SELECT coalesce(s.url, r.key) AS url, error FROM rec r LEFT JOIN store s ON s.key = r.key AND r.error <> '{fixed.ROBOTS_ERROR}') WHERE error <> '{fixed.ROBOTS_ERROR}' ORDER BY url LIMIT 400")
def failed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's list of failed pages: its length is the feature."""
    from webloom.operators import report

    return report.failed_pages(crawled(spark, sf_dir)[1].records)


@query("WITH " + _SEEN + " SELECT count(*) FILTER (error IS NULL AND hash_ok) AS written, count(*) FILTER (error IS NULL AND NOT hash_ok) AS failed FROM (SELECT r.*, s.page_id % 13 <> 0 AS hash_ok FROM rec r LEFT JOIN kind s USING (key))")
def finalize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten pages, and those whose snapshot is missing (every thirteenth)."""
    got, done = crawled(spark, sf_dir)
    return mirror.finalize(done, got.where("page_id % 13 <> 0"))[1]
