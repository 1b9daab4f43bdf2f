"""Crawls of several levels: every page is given links to three other pages, so that the corpus is one web.

Robots, walls, time-outs and files are those of ``mirror_plans``. In SQL the levels stand one after the other, each with its own budget.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import session
from webloom.functions import fixed, html as H, url as U
from webloom.functions.scope import Scope
from webloom.operators import frontier, links as L, mirror, report
from webloom.operators.journal import Journal, Stopped
from webloom.plans.base import SQL_TAGS, pages, query, sql_attr, sql_canonical, sql_page_like, sql_path, sql_strip
from webloom.plans.mirror_plans import _FILE, _TIMEOUT, _WALL, BLOCKED, fetched

SCOPE = Scope(max_depth=3, max_pages=150)
SEED_EVERY = 50
STEPS = (1, 2, 3)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with three more links each, to the pages 3 i + k modulo their number."""
    rows = pages(spark, sf_dir)
    n = rows.agg(F.count("*").alias("n"))
    to = rows.select(F.col("page_id").alias("to"), F.concat(F.lit('<a href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">more</a>')).alias("link"))
    asked = rows.crossJoin(F.broadcast(n)).select("page_id", F.explode(F.array(*[F.lit(k) for k in STEPS])).alias("k"), "n")  # n is one row
    links = asked.select("page_id", "k", F.pmod(F.col("page_id") * 3 + F.col("k"), F.col("n")).alias("to")).join(to, "to")
    more = links.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "link"))), lambda x: x["link"]), "").alias("more"))
    return rows.join(more, "page_id", "left").select("page_id", "url", F.concat("html", F.coalesce("more", F.lit(""))).alias("html"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What was fetched, the seeds, and a rule for each host."""
    web = session.materialise(planted(spark, sf_dir), "web")
    got = session.materialise(fetched(spark, sf_dir, web), "fetched")
    origins = L.page_links(web).select(U.origin(F.col("key")).alias("origin")).union(got.select(U.origin(F.col("key")))).distinct()
    rules = origins.select("origin", F.lit(0).alias("seq"), F.lit(False).alias("allow"), F.lit(BLOCKED).alias("prefix"))
    seeds = got.where(F.col("page_id") % SEED_EVERY == 0).select("key", F.col("page_id").alias("seq"))
    return got, seeds, rules


def deep(spark: SparkSession, sf_dir: str, journal: Journal | None = None) -> tuple[DataFrame, mirror.Mirror]:
    got, seeds, rules = _inputs(spark, sf_dir)
    return got, mirror.crawl(got, seeds, SCOPE, rules, journal=journal)


def _levels() -> str:
    """Each level in SQL: candidates, what robots refuse, what the budget admits and what it leaves."""
    out = [
        f"c0 AS (SELECT key, CAST(NULL AS VARCHAR) AS parent, page_id AS o FROM store WHERE page_id % {SEED_EVERY} = 0)", "s0 AS (SELECT key FROM store WHERE false)",
    ]
    for d in range(SCOPE.max_depth + 1):
        if d:
            out.append(f"c{d} AS (SELECT e.dst AS key, min(r.seq * 100000 + e.pos) AS o FROM a{d - 1} r JOIN edges e ON e.src = r.key GROUP BY e.dst)")
            out.append(f"s{d} AS (SELECT key FROM s{d - 1} UNION ALL SELECT key FROM a{d - 1})")
        shut = f"{sql_path('key')} LIKE '{BLOCKED}%'"
        out.append(f"x{d} AS (SELECT key, {d} AS depth FROM c{d} WHERE {shut}" + "".join(f" AND key NOT IN (SELECT key FROM x{k})" for k in range(d)) + ")")
        out.append(f"q{d} AS (SELECT key, row_number() OVER (ORDER BY o) - 1 AS seq FROM c{d} WHERE NOT {shut} AND key NOT IN (SELECT key FROM s{d}))")
        out.append(f"a{d} AS (SELECT key, seq, {d} AS depth FROM q{d} WHERE seq < {SCOPE.max_pages} - (SELECT count(*) FROM s{d}))")
        out.append(f"l{d} AS (SELECT key, {d} AS depth FROM q{d} WHERE key NOT IN (SELECT key FROM a{d}))")
    last = SCOPE.max_depth
    out.append(f"l{last + 1} AS (SELECT DISTINCT e.dst AS key, {last + 1} AS depth FROM a{last} r JOIN edges e ON e.src = r.key)")
    union = lambda name, n, cols: " UNION ALL ".join(f"SELECT {cols} FROM {name}{k}" for k in range(n))
    out.append(f"admitted AS ({union('a', last + 1, 'key, depth, seq')})")
    out.append(f"refused AS ({union('x', last + 1, 'key, depth')})")
    out.append(f"pending AS (SELECT key, min(depth) AS depth FROM ({union('l', last + 2, 'key, depth')}) WHERE key NOT IN (SELECT key FROM admitted) AND key NOT IN (SELECT key FROM refused) GROUP BY key)")
    return ", ".join(out)


_WEB = f"""web AS (SELECT p.page_id, p.url, p.html || coalesce(m.more, '') AS html FROM pages p LEFT JOIN (SELECT s.page_id, string_agg('<a href="' || replace(t.url, '&', '&amp;') || '">more</a>', '' ORDER BY k) AS more
  FROM pages s, (VALUES {', '.join(f'({k})' for k in STEPS)}) v(k), (SELECT count(*) AS n FROM pages) JOIN pages t ON t.page_id = (s.page_id * 3 + k) % n GROUP BY s.page_id) m USING (page_id))"""
_LINKS = SQL_TAGS.replace("{source}", "web") + f""", hrefs AS (SELECT page_id, url, CAST(pos AS INT) AS pos, {sql_strip(sql_attr("tag", "href"))} AS raw FROM tags WHERE name = 'a'), links AS (SELECT * FROM hrefs WHERE raw <> '')"""
DEEP_SQL = "WITH " + _WEB + ", " + _LINKS + f""", {sql_canonical("canon", "links", "raw", "url")}, src AS (SELECT page_id, url AS raw, NULL AS base, html FROM web), {sql_canonical("page", "src")},
store AS (SELECT key, min(page_id) AS page_id, arg_min(fetch_url, page_id) AS url, arg_min(html, page_id) AS html FROM page WHERE key IS NOT NULL GROUP BY key),
kind AS (SELECT *, CASE WHEN page_id % 11 = {_TIMEOUT} THEN 'timeout' WHEN page_id % 11 = {_WALL} THEN 'wall' WHEN page_id % 11 = {_FILE} THEN 'file' ELSE 'page' END AS k FROM store),
edges AS (SELECT s.key AS src, c.key AS dst, min(c.pos) AS pos FROM kind s JOIN canon c ON c.page_id = s.page_id WHERE s.k = 'page' AND c.key IS NOT NULL AND {sql_page_like("c.fetch_url")} GROUP BY s.key, c.key),
{_levels()},
rec AS (SELECT a.key, a.depth, a.seq, CASE k WHEN 'timeout' THEN 'timeout' WHEN 'wall' THEN 'challenge: server rate-limit (http 429)' WHEN 'page' THEN NULL ELSE '{mirror.NO_RESPONSE}' END AS error, CASE WHEN k = 'page' THEN length(html) ELSE 0 END AS bytes, k, s.url
  FROM admitted a LEFT JOIN kind s USING (key) WHERE coalesce(k, '') <> 'file' UNION ALL SELECT key, depth, NULL, '{fixed.ROBOTS_ERROR}', 0, 'blocked', NULL FROM refused)"""
_RECORDS = DEEP_SQL + " SELECT key, CAST(depth AS INT) AS depth, error, CAST(bytes AS BIGINT) AS bytes FROM rec"


@query(_RECORDS)
def deep_crawl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page that a crawl of four levels met, within its budget, which blocked pages take nothing of."""
    return deep(spark, sf_dir)[1].records.select("key", "depth", "error", "bytes")


@query(DEEP_SQL + " SELECT key, CAST(depth AS INT) AS depth FROM pending")
def deep_crawl_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the budget and the depth left, at its first depth."""
    return deep(spark, sf_dir)[1].pending.select("key", "depth")


@query(_RECORDS)
def restarted_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same crawl, stopped after every few steps and started again until it ends: its rows are those of a whole one."""
    run = f"restarted-{uuid.uuid4().hex}"
    while True:
        journal = Journal(spark, run, {"depth": SCOPE.max_depth, "pages": SCOPE.max_pages}, pause_after=3)
        try:
            records = deep(spark, sf_dir, journal)[1].records
        except Stopped:
            continue
        journal.forget()  # the records are a table of their own
        return records.select("key", "depth", "error", "bytes")


@query(
    DEEP_SQL + f""" SELECT count(*) FILTER (error IS NULL) AS pages, count(*) FILTER (error IS NOT NULL AND error <> '{fixed.ROBOTS_ERROR}') AS failed, count(*) FILTER (error = '{fixed.ROBOTS_ERROR}') AS blocked, count(*) FILTER (error LIKE 'challenge: %') AS walled,
  CAST(coalesce(max(depth) FILTER (error IS NULL), 0) AS INT) AS max_depth, count(*) FILTER (error LIKE 'challenge: %') AS walls_hit, (SELECT count(*) FROM kind WHERE k = 'wall' AND page_id % 2 = 0) AS cleared,
  (SELECT count(*) FROM kind WHERE k = 'file' AND key IN (SELECT key FROM admitted)) AS assets, (SELECT CAST(coalesce(sum(length(html)), 0) AS BIGINT) FROM kind WHERE k = 'file' AND key IN (SELECT key FROM admitted)) AS asset_bytes,
  (SELECT count(*) FROM pending) AS not_crawled, (SELECT string_agg(h, ',' ORDER BY h) FROM (SELECT DISTINCT regexp_extract(key, '^[a-z]+://([^/?#:]*)', 1) AS h FROM store WHERE page_id % 3 = 0 ORDER BY h LIMIT 3)) AS throttled,
  (SELECT string_agg(error, ',' ORDER BY depth, seq) FROM (SELECT * FROM rec WHERE error <> '{fixed.ROBOTS_ERROR}' ORDER BY depth, seq LIMIT 20)) AS failures FROM rec"""
)
def deep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of that crawl, with walls that were cleared, files, slowed hosts by name, and the first failures as they were met."""
    got, done = deep(spark, sf_dir)
    files = done.files.select("key").join(got, "key").select(F.length("html").cast("long").alias("size"), F.lit(None).cast("string").alias("error"))
    cleared = got.where((F.col("page_id") % 11 == _WALL) & (F.col("page_id") % 2 == 0)).agg(F.count("*").alias("solved"))
    slow = got.groupBy(U.host_of(F.col("key")).alias("host")).agg(F.max(F.when(F.col("page_id") % 3 == 0, 2.0).otherwise(1.0)).alias("multiplier"))
    one = mirror.summary(done, got, files, cleared, slow)
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",").alias(c)
    return one.select("pages", "failed", "blocked", "walled", F.col("max_depth").cast("int").alias("max_depth"), "walls_hit", "cleared", "assets", "asset_bytes", "not_crawled", names("throttled", "host"), F.array_join(F.transform("first_failures", lambda x: x["error"]), ",").alias("failures"))


@query(DEEP_SQL + f" SELECT CAST(row_number() OVER (ORDER BY depth, seq) AS INT) AS pos, coalesce(url, key) AS url, error FROM rec WHERE error <> '{fixed.ROBOTS_ERROR}' ORDER BY depth, seq LIMIT 20")
def failures_as_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty failed pages in the order in which the crawl met them: the list's length is the feature."""
    rows = report.first_failures(deep(spark, sf_dir)[1].records)
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("depth", "seq", "url", "error"))).alias("f"))  # twenty
    return packed.select(F.posexplode("f").alias("p", "f")).select((F.col("p") + 1).alias("pos"), "f.url", "f.error")


#: Of every page whether it was captured, and failed, from its id; what it links to are the planted links.
_GRAPH = """n AS (SELECT count(*) AS n FROM pages), edges AS (SELECT page_id AS src, (page_id * 3 + k) % n AS dst, k AS pos FROM pages, n, (VALUES (1), (2), (3)) v(k)),
p AS (SELECT page_id AS key, CAST(page_id % 3 AS INT) AS depth, page_id % 7 = 0 AS bad FROM pages WHERE page_id % 5 = 0), good AS (SELECT * FROM p WHERE NOT bad),
queue AS (SELECT e.dst AS key, min(g.depth + 1) AS depth FROM edges e JOIN good g ON g.key = e.src WHERE e.dst NOT IN (SELECT key FROM good) AND g.depth + 1 <= 4 GROUP BY e.dst),
b AS (SELECT key, depth FROM queue UNION SELECT page_id, 0 FROM pages WHERE page_id % 50 = 0 AND page_id NOT IN (SELECT key FROM good) UNION SELECT e.dst, b.depth + 1 FROM b JOIN edges e ON e.src = b.key WHERE b.depth < 4 AND e.dst NOT IN (SELECT key FROM good))"""


@query(f"WITH RECURSIVE {_GRAPH} SELECT key, CAST(min(depth) AS INT) AS depth FROM b GROUP BY key")
def resumed_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl fetches that goes on from captured pages: what they led to at its depth, what failed, and what both lead to."""
    from webloom.plans.crawl_plans import _edges

    i = F.col("page_id")
    have = pages(spark, sf_dir).where(i % 5 == 0).select(i.alias("key"), (i % 3).cast("int").alias("depth"), F.when(i % 7 == 0, "timeout").alias("error"))
    seeds = pages(spark, sf_dir).where(i % SEED_EVERY == 0).select(i.alias("key"), i.alias("seq"))
    return frontier.crawl_on(have, _edges(spark, sf_dir), seeds, Scope(max_depth=4, max_pages=0))[0].select("key", "depth")


_RULES = """rules AS (SELECT DISTINCT origin, substr(path, 1, k) AS prefix, k FROM target, (VALUES (2), (3), (5), (8)) v(k) WHERE length(path) >= k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY sha1(prefix), k) - 1 AS seq, sha1(prefix) < '8' AS allow FROM rules)"""


@query(
    "WITH " + _WEB + ", " + _LINKS + f""", {sql_canonical("canon", "links", "raw", "url")}, target AS (SELECT DISTINCT key, regexp_extract(key, '^([a-z]+://[^/?#]*)', 1) AS origin, {sql_path("key")} AS path FROM canon WHERE key IS NOT NULL AND {sql_page_like("fetch_url")}),
{_RULES} SELECT t.key, coalesce(arg_min(r.allow, r.seq), true) AS allowed FROM target t LEFT JOIN ranked r ON r.origin = t.origin AND starts_with(t.path, r.prefix) GROUP BY t.key"""
)
def robots_over_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links held against hundreds of rules, which are beginnings of the links' own paths: the first rule of a host that fits decides."""
    links = L.page_links(planted(spark, sf_dir)).select("key").distinct()
    origin = F.rtrim(U.origin(F.col("key")), F.lit("/"))
    asked = links.select("key", origin.alias("origin"), U.path_of(F.col("key")).alias("target"))
    made = asked.select("origin", F.explode(F.array(*[F.lit(k) for k in (2, 3, 5, 8)])).alias("k"), "target").where("length(target) >= k").select("origin", "k", F.substring("target", F.lit(1), F.col("k")).alias("prefix")).distinct()
    rules = made.select("origin", F.struct(F.sha1("prefix"), "k").alias("seq"), (F.sha1("prefix") < "8").alias("allow"), "prefix")
    return frontier.allowed(asked, rules).select("key", "allowed")


@query(DEEP_SQL + " SELECT CAST(row_number() OVER (ORDER BY depth, url) AS INT) AS pos, CAST(depth AS INT) AS depth, url FROM rec WHERE error IS NULL")
def pages_by_depth_and_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which the report takes pages."""
    rows = report.listed_pages(deep(spark, sf_dir)[1].records).select("depth", "url")
    return frontier.number(rows, ["depth", "url"]).select((F.col("seq") + 1).cast("int").alias("pos"), "depth", "url")
