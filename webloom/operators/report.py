"""Reports on a crawl: outcomes, stat cards, site trees, search, and the site map document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import fixed, html as H, url as U

#: Rows of a report's lists of failed and of pending pages, and of the console's.
REPORT_ROWS, CONSOLE_ROWS = 400, 20
#: Failed pages that the console names.
CONSOLE_FAILURES = 5


def outcome(error: Column, path: Column) -> Column:
    """``blocked`` (robots), ``walled``, ``failed``, ``ok``, or ``no path``."""
    return (
        F.when(error == fixed.ROBOTS_ERROR, "blocked").when(F.startswith(error, F.lit(fixed.WALL_PREFIX)), "walled").when(F.coalesce(error, F.lit("")) != "", "failed")
        .when(F.coalesce(path, F.lit("")) != "", "ok").otherwise("no path")
    )


def status_class(status: Column) -> Column:
    return F.when(status.isNull(), "s-unknown").when(status < 300, "s-ok").when(status < 400, "s-redir").otherwise("s-err")


def summary(crawled: DataFrame) -> DataFrame:
    """One row over crawled pages (error, path, depth): pages by outcome and the greatest depth. Failed pages include walled ones."""
    o = outcome(F.col("error"), F.col("path"))
    return crawled.agg(
        F.count_if(o == "ok").alias("ok"), F.count_if(o.isin("failed", "walled")).alias("failed"), F.count_if(o == "blocked").alias("blocked"),
        F.count_if(o == "walled").alias("walled"), F.coalesce(F.max(F.when(o == "ok", F.col("depth"))), F.lit(0)).alias("max_depth"),
    )


def asset_totals(assets: DataFrame) -> DataFrame:
    """One row over assets (size, error): those without an error, and the bytes of all, a decimal(38, 0) since longs may add up to more than a long."""
    total = F.coalesce(F.sum(F.col("size").cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)"))
    return assets.agg(F.count_if(F.col("error").isNull()).alias("n"), total.alias("total_bytes"))


def stats(crawled: DataFrame, assets: DataFrame, pending: DataFrame) -> DataFrame:
    """The report's seven cards: (seq, label, value)."""
    s, a, p = summary(crawled), asset_totals(assets), pending.agg(F.count("*").alias("pending"))
    one = s.crossJoin(a).crossJoin(p)  # three single rows
    cards = [
        ("pages", F.col("ok").cast("string")), ("assets", F.col("n").cast("string")), ("downloaded", H.human_bytes(F.col("total_bytes"))), ("max depth", F.col("max_depth").cast("string")),
        ("failed", F.col("failed").cast("string")), ("robots-skipped", F.col("blocked").cast("string")), ("not fetched", F.col("pending").cast("string")),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(label).alias("label"), v.alias("value")) for k, (label, v) in enumerate(cards)])).alias("c")).select("c.*")


def _parts(url: Column) -> Column:
    return F.transform(F.filter(F.split(U.path_of(url), "/"), lambda s: s != ""), lambda s: U.percent_decode(s))


def tree(urls: DataFrame) -> DataFrame:
    """(host, prefix, depth, n, own) for each prefix of each path: pages below it, and at it.

    Every page gives one row for each of its path's parts; the count combines before its shuffle.
    """
    rows = urls.select(F.when(U.host_of(F.col("fetch_url")) == "", "unknown").otherwise(U.host_of(F.col("fetch_url"))).alias("host"), _parts(F.col("fetch_url")).alias("p"))
    each = rows.select("host", F.size("p").alias("size"), "p", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("depth"))
    named = each.select("host", F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("prefix"), "depth", (F.col("size") == F.col("depth")).alias("at"))
    return named.groupBy("host", "prefix", "depth").agg(F.count("*").alias("n"), F.count_if("at").alias("own"))


def tree_rollup(urls: DataFrame) -> DataFrame:
    """Pages by host and top folder with totals, ``*`` standing for all."""
    rows = urls.select(U.host_of(F.col("fetch_url")).alias("host"), F.filter(F.split(U.path_of(F.col("fetch_url")), "/"), lambda s: s != "").alias("p"))
    return rows.select("host", F.get("p", F.lit(0)).alias("top")).rollup("host", "top").agg(F.count("*").alias("n")).select(F.coalesce("host", F.lit("*")).alias("host"), F.coalesce("top", F.lit("*")).alias("top"), "n")


def collapse(nodes: DataFrame) -> DataFrame:
    """Nodes of a tree without those that hold a single child and no page; ``label`` is the part below the next kept node above.

    A node's kept ancestors are found by its own prefixes, which are as many as its depth: an equi-join.
    """
    parent = F.when(F.col("depth") == 1, "").otherwise(F.regexp_replace("prefix", "/[^/]*$", ""))
    kids = nodes.where("depth > 0").groupBy("host", parent.alias("prefix")).agg(F.count("*").alias("kids"))
    kept = nodes.join(kids, ["host", "prefix"], "left").where("coalesce(kids, 0) <> 1 OR own > 0")
    parts = F.split("prefix", "/")
    up = kept.where("depth > 0").select("host", "prefix", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("above"))
    up = up.withColumn("key", F.array_join(F.slice(F.split("prefix", "/"), F.lit(1), F.col("above")), "/"))
    near = up.join(kept.select("host", F.col("prefix").alias("key")), ["host", "key"]).groupBy("host", "prefix").agg(F.max("above").alias("above"))
    below = F.array_join(F.slice(parts, F.col("above") + 1, F.size(parts)), "/")
    top = F.when(F.col("depth") == 0, F.col("host")).otherwise(F.concat_ws("/", "host", "prefix"))
    return kept.join(near, ["host", "prefix"], "left").withColumn("label", F.when(F.col("above").isNull(), top).otherwise(below))


def opens(depth: Column, total: Column) -> Column:
    """Whether a folder of the site map is shown open."""
    return (depth < 2) | (total <= 25)


def search(pages: DataFrame, term: str) -> DataFrame:
    """Pages whose title or URL has ``term``."""
    return pages.where(F.contains(F.lower(F.concat(H.title(F.col("html")), F.lit(" "), "url")), F.lit(term.lower())))


def failed_pages(crawled: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    return crawled.where(outcome(F.col("error"), F.col("path")).isin("failed", "walled")).orderBy("url").limit(rows).select("url", "error")


def pending_pages(pending: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    return pending.orderBy("key").limit(rows)


def throttled_hosts(multipliers: DataFrame, rows: int = 3) -> DataFrame:
    """The first hosts (host, multiplier), by name, that were slowed down: a report's list."""
    return multipliers.where(F.col("multiplier") > 1).orderBy("host").limit(rows)


def first_failures(crawled: DataFrame, rows: int = CONSOLE_ROWS) -> DataFrame:
    """The first failed pages as they were met: (depth, seq, url, error)."""
    return crawled.where(outcome(F.col("error"), F.col("path")).isin("failed", "walled")).orderBy("depth", "seq", "url").limit(rows).select("depth", "seq", "url", "error")


def listed_pages(crawled: DataFrame) -> DataFrame:
    """Pages that are shown in the site map, by depth and URL: (depth, url, title, path)."""
    return crawled.where(outcome(F.col("error"), F.col("path")) == "ok").orderBy("depth", "url").select("depth", "url", "title", "path")


def site_nodes(urls: DataFrame) -> DataFrame:
    """Folders of the site map (host, prefix, depth, label, n, is_open): the collapsed tree and whether each is shown open."""
    return collapse(tree(urls)).select("host", "prefix", "depth", "label", "n", opens(F.col("depth"), F.col("n")).alias("is_open"))


def duration(started: Column, finished: Column) -> Column:
    """Whole seconds that a crawl took."""
    return F.floor(F.timestamp_diff("MICROSECOND", started, finished) / 1e6).cast("long")


def local_time(at: Column) -> Column:
    """A time to the minute, in the session's time zone."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def megabytes(n: Column) -> Column:
    return F.concat(H.one_decimal(n, float(1 << 20)), F.lit(" MB"))


def start_page(crawled: DataFrame, starts: DataFrame) -> DataFrame:
    """(site, start_key, href) for ``starts`` (site, start_key): where the site map's link to the start page leads, empty where that page has no file."""
    path = crawled.select(F.col("key").alias("start_key"), "path")
    href = F.when(F.coalesce("path", F.lit("")) != "", U.relative_link(F.lit("index.html"), F.col("path"))).otherwise("")
    return starts.join(path, "start_key", "left").select("site", "start_key", href.alias("href"))


def console(summary: DataFrame, seconds: float) -> DataFrame:
    """(pos, line): what is said at the end of a crawl, from the row of ``mirror.summary``; ``pages`` above 0 means success."""
    some = lambda n, *text: F.when(F.col(n) > 0, F.concat(*text))
    n = lambda c: F.col(c).cast("string")
    slow = F.array_join(F.transform("throttled", lambda t: F.format_string("%s x%.0f", t["host"], t["multiplier"])), ", ")
    met = "first_failures" if "first_failures" in summary.columns else "failures"
    first = F.transform(F.slice(met, 1, CONSOLE_FAILURES), lambda f: F.concat(F.lit("  "), f["url"], F.lit(": "), f["error"]))
    lines = F.concat(
        F.array(F.concat(F.lit("pages: "), n("pages")), F.concat(F.lit("assets: "), n("assets"), F.lit(", "), megabytes(F.col("asset_bytes"))), F.concat(F.lit("greatest depth: "), n("max_depth"))),
        F.array(
            some("blocked", F.lit("left out by robots: "), n("blocked")), some("walled", F.lit("behind a wall: "), n("walled"), F.lit(", cleared: "), n("cleared")),
            F.when(F.size("throttled") > 0, F.concat(F.lit("slowed down: "), slow)), some("failed", F.lit("failed: "), n("failed")),
        ),
        first, F.array(some("not_crawled", F.lit("not fetched: "), n("not_crawled")), F.lit(f"seconds: {seconds:.0f}")),
    )
    return summary.select(F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("pos", "line"))


_STYLE = "div.n,div.p{margin-left:calc(var(--d)*1.2em)}div.n{font-weight:bold;cursor:pointer}.s-ok{color:green}.s-redir{color:orange}.s-err{color:red}"
#: Shows what has the typed words, and folds a folder's pages away.
_SCRIPT = "const q=document.getElementById('q');q.oninput=()=>{for(const e of document.querySelectorAll('.p'))e.hidden=!e.dataset.search.includes(q.value.toLowerCase())};for(const n of document.querySelectorAll('.n'))n.onclick=()=>{for(const e of document.querySelectorAll('.p'))if(e.dataset.at===n.dataset.at)e.hidden=!e.hidden};"


def site_map_lines(crawled: DataFrame) -> DataFrame:
    """(place, line): the site map's tree, a line of html for each folder and page, whatever their number; in order by ``place``.

    ``crawled``: (url, title, status, depth, path, error). Lines stand for themselves, indented by depth, so none waits for another.
    """
    ok = crawled.where(outcome(F.col("error"), F.col("path")) == "ok").withColumn("fetch_url", F.col("url"))
    host = F.when(U.host_of(F.col("url")) == "", "unknown").otherwise(U.host_of(F.col("url")))
    at = F.array_join(_parts(F.col("url")), "/")
    place = lambda host, prefix, kind, more: F.struct(host.alias("host"), F.split(prefix, "/").alias("path"), F.lit(kind).alias("kind"), more.alias("more"))
    where = lambda host, prefix: H.escape(F.concat_ws("/", host, F.nullif(prefix, F.lit(""))))
    folders = site_nodes(ok).where("n > 1").select(
        place(F.col("host"), F.col("prefix"), 0, F.col("label")).alias("place"),
        F.concat(F.lit('<div class="n" style="--d:'), F.col("depth").cast("string"), F.lit('" data-at="'), where(F.col("host"), F.col("prefix")), F.lit('" data-open="'), F.col("is_open").cast("string"), F.lit('">'), H.escape(F.col("label")), F.lit(" ("), F.col("n").cast("string"), F.lit(")</div>")).alias("line"),
    )
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"))
    above = F.regexp_replace(at, "(^|/)[^/]*$", "")
    pages = ok.select(
        place(host, at, 1, F.col("url")).alias("place"),
        F.concat(
            F.lit('<div class="p" style="--d:'), (F.size(_parts(F.col("url"))) + 1).cast("string"), F.lit('" data-at="'), where(host, above), F.lit('" data-search="'), H.escape(F.lower(F.concat_ws(" ", "title", "url"))), F.lit('"><a href="'),
            H.escape(U.relative_link(F.lit("index.html"), F.col("path"))), F.lit('">'), H.escape(title), F.lit('</a> <i class="'), status_class(F.col("status")), F.lit('">'), F.coalesce(F.col("status").cast("string"), F.lit("—")), F.lit("</i> d"), F.col("depth").cast("string"), F.lit("</div>"),
        ).alias("line"),
    )
    return folders.unionByName(pages)


def site_map(crawled: DataFrame, assets: DataFrame, pending: DataFrame, start_host: str) -> DataFrame:
    """(place, line) of the whole site map document, in order by ``place``: its head, the cards, the tree and the lists.

    It lists every page, so it stays a table: sort it by ``place`` and write its lines as text.
    """
    name = H.escape(F.lit(start_host))
    none = F.array().cast("array<string>")
    fixed_place = lambda kind, more: F.struct(F.lit("").alias("host"), none.alias("path"), F.lit(kind).alias("kind"), more.alias("more"))
    spark = crawled.sparkSession
    top = spark.range(1).select(fixed_place(0, F.lit("")).alias("place"), F.concat(F.lit("<!doctype html><html><head><meta charset='utf-8'><title>Mirror of "), name, F.lit(f"</title><style>{_STYLE}</style></head><body><h1>Mirror of "), name, F.lit("</h1><input id='q'>")).alias("line"))
    cards = stats(crawled, assets, pending).select(fixed_place(1, F.col("seq").cast("string")).alias("place"), F.concat(F.lit("<div><b>"), H.escape(F.col("value")), F.lit("</b> "), H.escape(F.col("label")), F.lit("</div>")).alias("line"))
    row = lambda *cells: F.concat(F.lit("<div class='row'>"), *[H.escape(F.coalesce(F.col(c).cast("string"), F.lit(""))) if isinstance(c, str) else c for c in cells], F.lit("</div>"))
    end = F.lit("\uffff")  # behind every host
    last = lambda kind, more: F.struct(end.alias("host"), none.alias("path"), F.lit(kind).alias("kind"), more.alias("more"))
    heads = spark.createDataFrame([(0, "<h2>Failed</h2>"), (2, "<h2>Not fetched</h2>"), (4, f"<script>{_SCRIPT}</script></body></html>")], "kind int, line string")
    heads = heads.select(F.struct(end.alias("host"), none.alias("path"), F.col("kind").alias("kind"), F.lit("").alias("more")).alias("place"), "line")
    failed = failed_pages(crawled).select(last(1, F.col("url")).alias("place"), row("url", F.lit(" "), "error").alias("line"))
    left = pending_pages(pending).select(last(3, F.col("key")).alias("place"), row("key", F.lit(" d"), "depth").alias("line"))
    out = top
    for part in (cards, site_map_lines(crawled), heads, failed, left):
        out = out.unionByName(part)
    return out
