"""Queries over a mirror's files, sessions and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import session
from webloom.functions import url as U
from webloom.operators import links as L, report, state
from webloom.plans.base import pages, query, sql_canonical
from webloom.sources import archives, site_files

_KEYS = f"src AS (SELECT page_id, url AS raw, NULL AS base, html FROM pages), {sql_canonical('page', 'src')}, first AS (SELECT key, arg_min(fetch_url, page_id) AS url, arg_min(html, page_id) AS html FROM page WHERE key IS NOT NULL GROUP BY key)"


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", U.canonical(F.col("url")).alias("c"), "html")
    return L.first_seen(rows.select("page_id", F.col("c.key").alias("key"), F.col("c.fetch_url").alias("url"), "html").where("key IS NOT NULL"), ["page_id"])


@query(f"WITH {_KEYS} SELECT key, length(html) AS n_chars, sha256(html) AS html_sha256 FROM first")
def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of all pages, written as files and read back by the records that name them."""
    got, root = _first(spark, sf_dir), session.place(spark, "site")
    site_files.store_snapshots(got, root)
    back = site_files.snapshots(got.select("key", site_files.raw_path(F.col("key")).alias("raw")), root)
    return back.select("key", F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("html_sha256"))


@query(f"WITH {_KEYS}, again AS (SELECT key AS page_id, key AS raw, NULL AS base FROM first), {sql_canonical('k', 'again')} SELECT page_id AS key, fetch_url FROM k")
def key_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first(spark, sf_dir).select("key", U.url_of_key(F.col("key")).alias("fetch_url"))


_EVENTS = "e AS (SELECT user_id AS site, ts, event_id, event_type FROM events)"


@query(
    f"""WITH {_EVENTS}, r AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER w AS epoch,
  last_value(CASE WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN 's' || event_id END IGNORE NULLS) OVER w AS session FROM e WINDOW w AS (PARTITION BY site ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT site, event_id, epoch, session FROM r WHERE event_type <> 'purchase'"""
)
def session_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fetch with the session of the last wall cleared before it; purchases stand for cleared walls, of which a third leave no cookies."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("site"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "event_type")
    left = F.when(F.col("seq") % 3 != 0, F.concat(F.lit("s"), F.col("seq").cast("string")))
    out = state.adopted_sessions(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'").select("site", "at", "seq", left.alias("session")))
    return out.select("site", F.col("seq").alias("event_id"), "epoch", "session")


@query(f"WITH {_EVENTS} SELECT site, arg_max(event_id::VARCHAR, (ts, event_id)) AS session FROM e WHERE event_type = 'view' AND event_id % 4 <> 0 GROUP BY site")
def remembered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cookies to keep of each site: views stand for answers of the start host, every fourth of which sets none."""
    i = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("site"), F.col("event_type").alias("host"), F.lit("view").alias("start_host"), F.col("ts").alias("at"), i.alias("seq"), F.when(i % 4 != 0, i.cast("string")).otherwise("").alias("cookies")
    )
    return state.remembered_sessions(rows)


@query(
    """SELECT user_id AS site, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS seconds, strftime(max(ts), '%Y-%m-%d %H:%M') AS finished,
  printf('%.1f MB', sum(event_id) * 1000 / 1048576.0) AS size FROM events GROUP BY user_id"""
)
def crawl_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each site's fetches took, when they ended, and how much came."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("site")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.sum("event_id").alias("n"))
    return rows.select("site", report.duration(F.col("a"), F.col("b")).alias("seconds"), report.local_time(F.col("b")).alias("finished"), report.megabytes(F.col("n") * 1000).alias("size"))


@query(f"WITH {_KEYS} SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS INT) AS pos, key AS line FROM first")
def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every page, written by many tasks as one file and read back in the file's order."""
    got, root = _first(spark, sf_dir), session.place(spark, "lines")
    site_files.store_lines(got.select(F.col("key").alias("place"), F.col("key").alias("line")), root)
    whole = spark.read.text(f"{root}/{site_files.SITE_MAP}", wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("pos", "line"))


_MAPS = """m AS (SELECT page_id % 9 AS site, page_id AS seq, 'https://s/' || (page_id // 20) || '.xml' AS url FROM pages),
u AS (SELECT m.site, min(m.seq) AS seq, m.url FROM m GROUP BY m.site, m.url)"""


@query(
    f"""WITH {_MAPS}, l AS (SELECT site, seq, k, 'https://h/' || split_part(url, '/', 4) || '/' || k || CASE WHEN k = 1 THEN '?a=1&b=2' ELSE '' END AS loc FROM u, (VALUES (0), (1), (2)) v(k))
SELECT site, CAST(pos AS INT) AS pos, loc AS url FROM (SELECT site, row_number() OVER (PARTITION BY site ORDER BY seq, k) - 1 AS pos, loc FROM l) WHERE pos < 20"""
)
def sitemaps_named_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps that sites name again and again: each is read once, where it is named first, up to the limit."""
    from webloom.sources import feeds

    i = F.col("page_id")
    name = F.concat(F.expr("page_id div 20").cast("string"), F.lit(".xml"))
    loc = lambda k, more: F.concat(F.lit("<url><loc> https://h/"), name, F.lit(f"/{k}{more}</loc></url>"))
    body = F.concat(F.lit("<urlset>"), loc(0, ""), loc(1, "?a=1&amp;b=2"), loc(2, ""), F.lit("</urlset>"))
    maps = pages(spark, sf_dir).select((i % 9).alias("site"), i.alias("seq"), F.concat(F.lit("https://s/"), name).alias("url"), body.alias("body"))
    return feeds.sitemap_urls(maps, 20)


@query(f"WITH {_KEYS}, i AS (SELECT key, min(page_id) AS i FROM page WHERE key IS NOT NULL GROUP BY key) SELECT key, length(html) AS n_chars, sha256(html) AS html_sha256 FROM first JOIN i USING (key) WHERE i % 3 = 1")
def archived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, stored as a fetcher's archives; those with one status are read back, by a filter that the archives apply."""
    got, root = _first(spark, sf_dir), session.place(spark, "archives")
    archives.store_pages(got.withColumn("status", F.col("page_id") % 3), root)
    back = archives.fetched(spark, columns=["key", "html", "status"], root=root).where("status = 1")
    return back.select("key", F.length("html").cast("long").alias("n_chars"), F.sha2("html", 256).alias("html_sha256"))
