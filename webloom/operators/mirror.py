"""From seeds and fetched pages to a mirror: crawl, records, rewritten pages and the summary, each a table.

``fetched`` is what a fetcher gave for each URL: (key, url, html, title, status, content_type, error). It is the store that the
crawl reads instead of a network; a URL that it lacks got no response.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom import session
from webloom.functions import fixed, html as H, url as U, walls
from webloom.functions.scope import Scope
from webloom.operators import frontier, links as L, report, rewrite
from webloom.operators.journal import Journal, Unkept
from webloom.sources import feeds

NO_RESPONSE = "no response"


@dataclass(frozen=True)
class Mirror:
    """``records``: (key, url, path, raw, title, status, depth, seq, parent, n_links, bytes, error); ``files``: keys that are no
    pages and are stored as assets; ``pending``: (key, depth) of what was met and not fetched."""

    records: DataFrame
    files: DataFrame
    pending: DataFrame


def judged(fetched: DataFrame) -> DataFrame:
    """``fetched`` with ``wall``, ``failure`` (what keeps a page out of the mirror) and ``is_page``.

    An error with html is still a page; a wall never is; another content type is a file, not a failure.
    """
    rows = fetched.withColumn("wall", walls.detect(F.col("html"), F.col("title"), F.col("status")))
    blank = F.coalesce("html", F.lit("")) == ""
    failure = F.when(F.col("error").isNotNull() & blank, F.col("error")).when(F.col("wall").isNotNull(), walls.as_error(F.col("wall")))
    rows = rows.withColumn("failure", failure)
    return rows.withColumn("is_page", F.col("failure").isNull() & feeds.is_html(F.col("content_type")))


def crawl(fetched: DataFrame, seeds: DataFrame, scope: Scope, rules: DataFrame | None = None, sitemap: DataFrame | None = None, journal: Journal | None = None) -> Mirror:
    """The mirror of what ``seeds`` (key, seq) lead to.

    Robots ``rules`` (origin, with or without its last slash, seq, allow, prefix) come before the budget: a page that they block is recorded, takes no place and leads
    nowhere. Failed pages are recorded with their error in place of a page; only pages lead on. With a ``journal``, a crawl that was stopped goes on.
    """
    step = (journal or Unkept()).step
    seen, _ = step("judged", lambda: judged(fetched))
    pages = seen.where("is_page")
    found = pages.select("key", F.posexplode_outer(L.page_keys(F.coalesce("html", F.lit("")), F.col("url"), scope)).alias("pos", "dst")).where("dst IS NOT NULL")
    edges, _ = step("links", lambda: found.select(F.col("key").alias("src"), "dst", "pos"))
    blocked = None
    if rules is not None:
        keys = edges.select(F.col("dst").alias("key")).unionByName(seeds.select("key"))
        if sitemap is not None:
            keys = keys.unionByName(sitemap.select("key"))
        target = F.concat(U.path_of(F.col("key")), F.when(U.query_of(F.col("key")) != "", F.concat(F.lit("?"), U.query_of(F.col("key")))).otherwise(""))
        bare = lambda origin: F.rtrim(origin, F.lit("/")).alias("origin")
        asked = keys.distinct().select("key", bare(U.origin(F.col("key"))), target.alias("target"))
        rules = rules.select(bare(F.col("origin")), "seq", "allow", "prefix")
        blocked, _ = step("blocked", lambda: frontier.allowed(asked, rules).where("NOT allowed").select("key"))
    admitted, pending, refused = frontier.crawl_with_refused(edges, seeds, scope, pages.select("key"), sitemap, blocked, journal)
    facts = seen.select("key", "url", "html", "title", "status", "failure", "is_page", F.lit(True).alias("there"))
    rows = admitted.join(facts, "key", "left").withColumn("error", F.when(F.col("there").isNull(), NO_RESPONSE).otherwise(F.col("failure")))
    files = rows.where("error IS NULL AND NOT is_page").select("key", "depth")
    rows = rows.where("error IS NOT NULL OR is_page")
    ok = F.col("error").isNull()
    paths = L.allocate_paths(rows.where(ok).select("seq", "depth", "key", U.page_path(F.col("url")).alias("path")).withColumn("seq", F.struct("depth", "seq")).drop("depth"))
    n_links = edges.groupBy(F.col("src").alias("key")).agg(F.count("*").alias("n_links"))
    rows = rows.join(paths.select("key", "path"), "key", "left").join(n_links, "key", "left")
    good = lambda c, other: F.when(ok, F.coalesce(c, other)).otherwise(other)
    records = rows.select(
        "key", F.coalesce("url", "key").alias("url"), good(F.col("path"), F.lit("")).alias("path"), good(F.concat(F.lit(f"{fixed.RAW_DIR}/"), F.sha1("key"), F.lit(".html")), F.lit("")).alias("raw"),
        good(F.col("title"), F.lit("")).alias("title"), F.when(ok, F.col("status")).alias("status"), "depth", "seq", "parent", good(F.col("n_links"), F.lit(0)).cast("long").alias("n_links"),
        good(F.length("html").cast("long"), F.lit(0)).cast("long").alias("bytes"), "error",
    )
    if refused is not None:
        text = lambda v: F.lit(v).cast("string")
        skipped = refused.select(
            "key", F.col("key").alias("url"), text("").alias("path"), text("").alias("raw"), text("").alias("title"), F.lit(None).cast("int").alias("status"), "depth", F.lit(None).cast("long").alias("seq"),
            "parent", F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("bytes"), text(fixed.ROBOTS_ERROR).alias("error"),
        )
        records = records.unionByName(skipped)
        pending = pending.join(refused.select("key"), "key", "left_anti")
    return Mirror(session.materialise(records, "records"), files, pending)


def finalize(mirror: Mirror, snapshots: DataFrame, assets: DataFrame | None = None, scope: Scope | None = None) -> tuple[DataFrame, DataFrame]:
    """Rewritten pages (key, path, html, n_local, n_remote), and counts (written, failed).

    ``snapshots``: (key, html), the stored pages; a record without its snapshot counts as failed.
    """
    ok = mirror.records.where("error IS NULL AND path <> ''")
    rows = ok.join(snapshots.select("key", "html"), "key", "left")
    held = rows.where("html IS NOT NULL").withColumn("page_id", F.xxhash64("key"))
    out = rewrite.rewrite_pages(held.select("page_id", "url", "path", "html"), ok.select("key", "path"), assets, scope)
    pages = held.select("page_id", "key", "path").join(out, "page_id").drop("page_id")
    counts = rows.agg(F.count("html").alias("written"), F.count_if(F.col("html").isNull()).alias("failed"))
    return pages, counts


def summary(mirror: Mirror, fetched: DataFrame, assets: DataFrame | None = None, cleared: DataFrame | None = None, multipliers: DataFrame | None = None) -> DataFrame:
    """One row: pages by outcome, walls met and cleared, hosts that were slowed down, assets, what was left, the greatest depth.

    ``throttled`` names the first hosts that were slowed down, ``failures`` failed pages by URL, ``first_failures`` those met first; all are
    a report's lists.
    """
    r = mirror.records
    one = report.summary(r).withColumnRenamed("ok", "pages")
    walled = judged(fetched).where("wall IS NOT NULL").join(r.where(F.coalesce("error", F.lit("")) != fixed.ROBOTS_ERROR).select("key"), "key", "left_semi").agg(F.count("*").alias("walls_hit"))
    solved = (cleared.agg(F.coalesce(F.max("solved"), F.lit(0)).alias("cleared")) if cleared is not None else one.select(F.lit(0).alias("cleared"))).select(F.col("cleared").cast("long"))
    stored = assets.select("size", "error") if assets is not None else mirror.files.select(F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("error"))
    left = mirror.pending.agg(F.count("*").alias("not_crawled"))
    failures = report.failed_pages(r, report.CONSOLE_ROWS).agg(F.array_sort(F.collect_list(F.struct("url", "error"))).alias("failures"))
    met = report.first_failures(r).agg(F.array_sort(F.collect_list(F.struct("depth", "seq", "url", "error"))).alias("f")).select(F.transform("f", lambda x: F.struct(x["url"].alias("url"), x["error"].alias("error"))).alias("first_failures"))
    slow = F.array().cast("array<struct<multiplier:double,host:string>>")
    hosts = one.select(slow.alias("throttled"))
    if multipliers is not None:
        top = report.throttled_hosts(multipliers)
        hosts = top.agg(F.array_sort(F.collect_list(F.struct("host", "multiplier"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["multiplier"].alias("multiplier"), x["host"].alias("host"))).alias("throttled"))
    out = one
    kept = report.asset_totals(stored).select(F.col("n").alias("assets"), F.col("total_bytes").cast("long").alias("asset_bytes"))  # what is on disks fits a long
    for part in (walled, solved, kept, left, hosts, failures, met):
        out = out.crossJoin(part)  # single rows
    return out


def titles(fetched: DataFrame) -> DataFrame:
    """``fetched`` with the title that its html gives, where there is none."""
    return fetched.withColumn("title", F.coalesce("title", H.title(F.coalesce("html", F.lit("")))))
