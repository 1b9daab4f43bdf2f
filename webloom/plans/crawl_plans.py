"""Queries over derived link graphs and fetch outcomes.

The pages link to nothing in the corpus, so the graph is ``page_id -> (3 * page_id + k) mod n``, and outcomes follow from
``page_id``; both are worked out alike here and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom import session
from webloom.functions import fixed, html as H, walls
from webloom.functions.scope import Scope
from webloom.operators import frontier, report, state
from webloom.plans.base import each_page, each_page_sql, pages, query, values
from webloom.sources import feeds

_EDGES = "n AS (SELECT count(*) AS n FROM pages), edges AS (SELECT page_id AS src, (page_id * 3 + k) % n AS dst, k AS pos FROM pages, n, (VALUES (1), (2), (3)) v(k))"
DEPTH, BUDGET = 4, 40


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pages(spark, sf_dir).select("page_id")
    n = ids.agg(F.count("*").alias("n"))
    return ids.crossJoin(F.broadcast(n)).select(F.col("page_id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pos"), "n").select("src", F.pmod(F.col("src") * 3 + F.col("pos"), F.col("n")).alias("dst"), "pos")  # n is one row


#: Pages to a seed, so that a crawl reaches a share of the pages whatever their number is.
SEED_EVERY = 50


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pages(spark, sf_dir).where(F.col("page_id") % SEED_EVERY == 0).select("page_id")
    return ids.select(F.col("page_id").alias("key"), F.expr(f"page_id div {SEED_EVERY}").alias("seq"))


_BFS = f"""b AS (SELECT page_id AS key, 0 AS depth FROM pages WHERE page_id % {SEED_EVERY} = 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN edges e ON e.src = b.key WHERE b.depth < {DEPTH}),
found AS (SELECT key, min(depth) AS depth FROM b GROUP BY key)"""


@query(f"WITH RECURSIVE {_EDGES}, {_BFS} SELECT key, CAST(depth AS INT) AS depth FROM found")
def bfs_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted, _ = frontier.crawl(_edges(spark, sf_dir), _seeds(spark, sf_dir), Scope(max_depth=DEPTH, max_pages=0))
    return admitted.select("key", "depth")


@query(f"WITH RECURSIVE {_EDGES}, {_BFS} SELECT DISTINCT e.dst AS key, {DEPTH + 1} AS depth FROM found f JOIN edges e ON e.src = f.key WHERE f.depth = {DEPTH} AND e.dst NOT IN (SELECT key FROM found)")
def bfs_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, deferred = frontier.crawl(_edges(spark, sf_dir), _seeds(spark, sf_dir), Scope(max_depth=DEPTH, max_pages=0))
    return deferred


#: Of each page whether it was crawled, failed or not reached, from its id: every page and every edge is looked at.
_STATE = "p AS (SELECT page_id AS key, CAST(page_id % 4 AS INT) AS depth, page_id % 5 = 0 AS crawled, page_id % 7 = 0 AS bad FROM pages)"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return pages(spark, sf_dir).select(i.alias("key"), (i % 4).cast("int").alias("depth"), (i % 5 == 0).alias("crawled"), F.when(i % 7 == 0, "timeout").alias("error"))


@query(f"WITH {_EDGES}, {_STATE} SELECT DISTINCT e.dst AS key FROM edges e WHERE e.dst NOT IN (SELECT key FROM p WHERE crawled)")
def frontier_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _states(spark, sf_dir).where("crawled").select("key")
    cand = _edges(spark, sf_dir).select(F.col("dst").alias("key"))
    return cand.join(seen, "key", "left_anti").distinct()


@query(
    f"""WITH {_EDGES}, {_STATE}, cand AS (SELECT dst AS key, min(src * 10 + pos) AS o FROM edges WHERE dst NOT IN (SELECT key FROM p WHERE crawled) GROUP BY dst)
SELECT key, seq FROM (SELECT key, row_number() OVER (ORDER BY o) - 1 AS seq FROM cand) WHERE seq < {BUDGET}"""
)
def budgeted_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget is the feature here: what it admits of all candidates."""
    seen = _states(spark, sf_dir).where("crawled").select("key")
    cand = _edges(spark, sf_dir).select(F.col("dst").alias("key"), F.col("src").alias("parent"), F.col("src").alias("parent_seq"), F.col("pos").cast("long").alias("pos"))
    admitted, _ = frontier.admit(cand, seen, BUDGET)
    return admitted.select("key", "seq")


@query(
    f"""WITH {_EDGES}, {_STATE}, good AS (SELECT * FROM p WHERE NOT bad)
SELECT e.dst AS key, CAST(min(g.depth + 1) AS INT) AS depth FROM edges e JOIN good g ON g.key = e.src WHERE g.depth + 1 <= 3 AND e.dst NOT IN (SELECT key FROM good) GROUP BY e.dst"""
)
def resume_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue, _ = frontier.resume(_states(spark, sf_dir), _edges(spark, sf_dir), Scope(max_depth=3))
    return queue


@query(
    """WITH RECURSIVE p AS (SELECT page_id AS key, CASE WHEN page_id > 0 THEN page_id // 3 END AS parent FROM pages),
l AS (SELECT key, parent AS ancestor, 1 AS up FROM p WHERE parent IS NOT NULL UNION ALL SELECT l.key, p.parent, l.up + 1 FROM l JOIN p ON p.key = l.ancestor WHERE p.parent IS NOT NULL AND l.up < 4)
SELECT key, ancestor, up FROM l"""
)
def parent_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select(F.col("page_id").alias("key"), F.when(F.col("page_id") > 0, F.expr("page_id div 3")).alias("parent"))
    return frontier.lineage(rows, 4)


@query(f"WITH RECURSIVE {_EDGES}, {_BFS} SELECT CAST(depth AS INT) AS depth, count(*) AS n, min(key) AS first, max(key) AS last FROM found GROUP BY depth")
def pages_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted, _ = frontier.crawl(_edges(spark, sf_dir), _seeds(spark, sf_dir), Scope(max_depth=DEPTH, max_pages=0))
    return admitted.groupBy("depth").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))


# Fetch outcomes by page_id % 10.
_ERRORS = {3: fixed.ROBOTS_ERROR, 5: "challenge: cloudflare captcha (challenge platform)", 7: "http 503", 8: "TimeoutException"}
_STATUS = {0: 200, 1: 301, 2: 404, 4: 204, 5: 403, 6: 429, 7: 503, 9: 200}
_TYPES = {0: "text/html; charset=utf-8", 1: "application/pdf", 2: "", 3: "Application/XHTML+XML", 4: "image/png", 5: "text/xml", 6: "text/htmlx", 7: " text/html", 8: "application/json", 9: "application/xml;q=1"}


def _case(table: dict) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(F.col("page_id") % 10 == k, F.lit(v))
    return out.otherwise(F.lit(None))


_OUTCOMES = "o AS (SELECT page_id, url, CAST(page_id % 6 AS INT) AS depth, e.v AS error, CAST(s.v AS INT) AS status, t.v AS content_type, CASE WHEN page_id % 10 <> 4 THEN 'pages/x.html' ELSE '' END AS path, length(html) AS bytes FROM pages LEFT JOIN e ON e.k = page_id % 10 LEFT JOIN s ON s.k = page_id % 10 LEFT JOIN t ON t.k = page_id % 10)"
_OUT = "WITH " + ", ".join(values(n, "k, v", list(t.items())) for n, t in (("e", _ERRORS), ("s", _STATUS), ("t", _TYPES))) + ", " + _OUTCOMES


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(
        "page_id", "url", F.expr("int(page_id % 6)").alias("depth"), _case(_ERRORS).cast("string").alias("error"), _case(_STATUS).cast("int").alias("status"), _case(_TYPES).cast("string").alias("content_type"),
        F.when(F.col("page_id") % 10 != 4, "pages/x.html").otherwise("").alias("path"), F.length("html").cast("long").alias("bytes"),
    )


_SUMMARY = """SELECT count(*) FILTER (error IS NULL AND path <> '') AS ok, count(*) FILTER (error IS NOT NULL AND error <> 'blocked by robots.txt') AS failed, count(*) FILTER (error = 'blocked by robots.txt') AS blocked,
  count(*) FILTER (error LIKE 'challenge: %') AS walled, coalesce(max(depth) FILTER (error IS NULL AND path <> ''), 0) AS max_depth FROM o"""


@query(_OUT + " " + _SUMMARY)
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_outcomes(spark, sf_dir))


@query(_OUT + " SELECT CASE WHEN error = 'blocked by robots.txt' THEN 'blocked' WHEN error LIKE 'challenge: %' THEN 'walled' WHEN error IS NOT NULL THEN 'failed' WHEN path <> '' THEN 'ok' ELSE 'no path' END AS outcome, count(*) AS n FROM o GROUP BY 1")
def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).groupBy(report.outcome(F.col("error"), F.col("path")).alias("outcome")).agg(F.count("*").alias("n"))


@query(_OUT + " SELECT CASE WHEN status IS NULL THEN 's-unknown' WHEN status < 300 THEN 's-ok' WHEN status < 400 THEN 's-redir' ELSE 's-err' END AS class, count(*) AS n FROM o GROUP BY 1")
def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).groupBy(report.status_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"))


_HUMAN = """CASE WHEN {n} < 1024 THEN format('{{:.0f}} B', {n}::DOUBLE) WHEN {n} < 1048576 THEN format('{{:.1f}} KB', {n} / 1024.0::DOUBLE) WHEN {n} < 1073741824 THEN format('{{:.1f}} MB', {n} / 1048576.0::DOUBLE)
  WHEN {n} < 1099511627776 THEN format('{{:.1f}} GB', {n} / 1073741824.0::DOUBLE) WHEN {n} < 1125899906842624 THEN format('{{:.1f}} TB', {n} / 1099511627776.0::DOUBLE) ELSE format('{{:.1f}} PB', {n} / 1125899906842624.0::DOUBLE) END"""


@query(
    _OUT + f""", s1 AS ({_SUMMARY}), a AS (SELECT count(*) FILTER (error IS NULL) AS n, CAST(sum(bytes) AS BIGINT) AS total FROM o), p AS (SELECT count(*) AS pending FROM o WHERE depth = 5)
SELECT CAST(c.seq AS INT) AS seq, c.label, c.value FROM s1, a, p, LATERAL (VALUES (0, 'pages', CAST(ok AS VARCHAR)), (1, 'assets', CAST(n AS VARCHAR)), (2, 'downloaded', {_HUMAN.format(n='total')}), (3, 'max depth', CAST(max_depth AS VARCHAR)),
  (4, 'failed', CAST(failed AS VARCHAR)), (5, 'robots-skipped', CAST(blocked AS VARCHAR)), (6, 'not fetched', CAST(pending AS VARCHAR))) c(seq, label, value)"""
)
def report_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir)
    return report.stats(rows, rows.select("error", F.col("bytes").alias("size")), rows.where("depth = 5"))


@query(_OUT + " SELECT page_id, content_type FROM o WHERE regexp_matches(lower(trim(string_split(coalesce(content_type, ''), ';')[1])), '^(|text/html.*|application/xhtml.*|application/xml.*|text/xml.*)$')")
def html_content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).where(feeds.is_html(F.col("content_type"))).select("page_id", "content_type")


@query(_OUT + " SELECT page_id, status FROM o WHERE status IN (429, 500, 502, 503, 504)")
def retryable_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).where(frontier.is_retryable(F.col("status"))).select("page_id", "status")


_LONG = "Plain words of a page that goes on and on. " * 100
#: name, html, title, status, and what the rules make of it: kind, vendor, detail.
WALLS = [
    ("interstitial", '<title>Wait</title><div id="challenge-form"></div><p>One second</p>', "Wait", None, "interstitial", "cloudflare", "challenge platform"),
    ("interstitial long", f"<p>{_LONG}</p><script src='/cdn-cgi/challenge-platform/x'></script>", "", 200, "interstitial", "cloudflare", "challenge platform"),
    ("interstitial turnstile", "<i>_cf_chl_opt</i> turnstile", "", 503, "captcha", "cloudflare", "challenge platform"),
    ("error 1020", "<div class=cf-error-details>No entry: error 1020</div>", "", 403, "denied", "cloudflare", "error 1020"),
    ("error 1015", "<body>Error 1015, come back later (cloudflare)</body>", "", 429, "rate-limit", "cloudflare", "error 1015"),
    ("error code", "<body>cloudflare error code: 1009</body>", "", 200, "denied", "cloudflare", "error 1009"),
    ("error colon", "<body>cloudflare error: 1020</body>", "", 200, None, None, None),
    ("widget", '<p>Tick the box</p><div class="cf-turnstile"></div>', "", 403, "captcha", "cloudflare-turnstile", "captcha wall"),
    ("hcaptcha", '<p>Solve it</p><div class="h-captcha"></div>', "", 403, "captcha", "hcaptcha", "captcha wall"),
    ("signup", f'<p>{_LONG}</p><form><div class="g-recaptcha"></div></form>', "Sign up", 200, None, None, None),
    ("signup denied", f'<p>{_LONG}</p><form><div class="g-recaptcha"></div></form>', "Sign up", 403, "captcha", "recaptcha", "captcha wall"),
    ("datadome", "<script src='https://geo.captcha-delivery.com/x'></script>", "", None, "captcha", "datadome", "captcha wall"),
    ("429", f"<p>{_LONG}</p>", "", 429, "rate-limit", "server", "http 429"),
    ("slow down", "<p>Please slow down</p>", "", None, "rate-limit", "server", "too many requests"),
    ("slow down 200", "<p>Please slow down</p>", "", 200, "rate-limit", "server", "http 200"),
    ("403", "<p>Access denied</p><i>akamai</i>", "", 403, "denied", "akamai", "http 403"),
    ("503 title", "<p>wait</p>", "Attention Required! here", 503, "interstitial", "unknown", "http 503"),
    ("title", "<p>wait</p>", " Just a moment ", None, "interstitial", "cloudflare", "interstitial title"),
    ("wording", "<p>Are you a   robot?</p> imperva", "", 200, "interstitial", "imperva", "wall wording"),
    ("weak wording", "<p>Access denied</p>", "", 200, None, None, None),
    ("login", "<p>You must be logged in</p>", "", 200, "login-wall", "site", "login required"),
    ("article", f"<p>{_LONG} error 1020 cloudflare checking your browser</p>", "How walls work", 200, None, None, None),
    ("script only", "<script>are you a robot</script><p>Hello</p>", "", 200, None, None, None),
    ("empty", "", "", 200, None, None, None),
    ("plain", f"<h1>Hi</h1><p>{_LONG}</p>", "Docs", 200, None, None, None),
]
_WALL_SQL = "WITH " + each_page_sql("w", "name, html, title, status, kind, vendor, detail", WALLS)


def _walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's number in front of each typed page."""
    rows = each_page(spark, sf_dir, "name string, html string, title string, status int", [w[:4] for w in WALLS])
    rows = rows.withColumn("html", F.when(F.col("html") != "", F.concat(F.lit("<i id="), F.col("page_id").cast("string"), F.lit("></i>"), "html")).otherwise(""))
    return rows.withColumn("wall", walls.detect(F.col("html"), F.col("title"), F.col("status")))


@query(_WALL_SQL + " SELECT page_id, name, kind, vendor, detail, coalesce(kind IN ('interstitial', 'captcha', 'login-wall'), false) AS clearable, 'challenge: ' || vendor || ' ' || kind || ' (' || detail || ')' AS error FROM w")
def wall_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walls(spark, sf_dir).select("page_id", "name", "wall.*", F.coalesce(walls.human_clearable(F.col("wall.kind")), F.lit(False)).alias("clearable"), walls.as_error(F.col("wall")).alias("error"))


@query(_WALL_SQL + " SELECT coalesce(kind, 'page') AS kind, count(*) AS n FROM w GROUP BY 1")
def wall_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walls(spark, sf_dir).groupBy(F.coalesce("wall.kind", F.lit("page")).alias("kind")).agg(F.count("*").alias("n"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS host, round(list_reduce(list_prepend(1.0::DOUBLE, list(CASE WHEN event_type = 'error' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, event_id)),
  lambda m, e: CASE WHEN e < 0 THEN least(32.0, m * 2) ELSE greatest(1.0, m / 1.15) END), 6) AS multiplier FROM events GROUP BY user_id"""
)
def throttle_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("host"), (F.col("event_type") == "error").alias("bad"), "ts", "event_id")
    return state.throttle_multiplier(log, ["ts", "event_id"]).select("host", F.round("multiplier", 6).alias("multiplier"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) / 1000 AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, t0 AS due FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, greatest(e.t0, s.due + 0.4) FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id, round(due, 3) AS due FROM s"""
)
def throttle_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand times as fast as the log, so that requests do wait."""
    log = _events(spark, sf_dir).select(F.col("user_id").alias("host"), "event_id", "ts", (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e9).alias("at"))
    return state.throttle_schedule(log, ["ts", "event_id"]).select("event_id", F.round("due", 3).alias("due"))


_ATTEMPTS = """a AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 ELSE 200 END AS status,
  CASE WHEN event_type = 'click' THEN 'captcha' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'denied' END AS wall, event_id % 2 = 0 AS html_empty, event_type = 'view' AND event_id % 3 = 0 AS error, event_id % 4 <> 0 AS cleared FROM events)"""


@query(
    "WITH RECURSIVE " + _ATTEMPTS + """, f AS (SELECT *, coalesce(wall = 'captcha', false) AS clr, NOT coalesce(wall = 'captcha', false) AND status IN (429, 503) AS lim FROM a),
s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS seq, '' AS outcome, 0 AS attempts, 0 AS slowdowns, 0 AS clears, 0 AS walls, 0.0::DOUBLE AS waited FROM f
UNION ALL SELECT s.key, f.seq, CASE WHEN lim AND s.slowdowns < 2 OR clr AND s.clears < 2 AND cleared OR wall IS NULL AND NOT lim AND error AND html_empty AND s.slowdowns < 2 THEN ''
    WHEN lim THEN 'rate limited' WHEN wall IS NOT NULL THEN 'walled' WHEN error THEN 'error' ELSE 'ok' END,
  s.attempts + 1, s.slowdowns + CASE WHEN (lim OR wall IS NULL AND error AND html_empty) AND s.slowdowns < 2 THEN 1 ELSE 0 END, s.clears + CASE WHEN clr AND s.clears < 2 AND cleared THEN 1 ELSE 0 END,
  s.walls + CASE WHEN NOT lim AND wall IS NOT NULL THEN 1 ELSE 0 END, s.waited + CASE WHEN s.slowdowns >= 2 THEN 0 WHEN lim THEN 5 * power(2, s.slowdowns) WHEN wall IS NULL AND error AND html_empty THEN 5 ELSE 0 END
  FROM s JOIN f ON f.key = s.key AND f.seq = s.seq + 1 WHERE s.outcome = '')
SELECT key, CASE WHEN outcome = '' THEN 'unfinished' ELSE outcome END AS outcome, attempts, slowdowns, walls, waited FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS last FROM s) WHERE last = 1"""
)
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind, k = _events(spark, sf_dir), F.col("event_type"), F.col("event_id")
    rows = e.select(
        F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.when(kind == "error", 503).when(kind == "signup", 429).otherwise(200).alias("status"),
        F.when(kind == "click", "captcha").when((kind == "purchase") & (k % 5 == 0), "denied").alias("wall"), (k % 2 == 0).alias("html_empty"), ((kind == "view") & (k % 3 == 0)).alias("error"), (k % 4 != 0).alias("cleared"),
    )
    return state.retry_outcomes(rows, Scope())


_SIZES = "z AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(pow(10, l_linenumber) AS BIGINT) AS n FROM lineitem)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.round(F.col("l_extendedprice") * 100).cast("long") * F.pow(F.lit(10.0), F.col("l_linenumber")).cast("long")).alias("n"))


@query(f"WITH {_SIZES} SELECT id, {_HUMAN.format(n='n')} AS size FROM z")
def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("id", H.human_bytes(F.col("n")).alias("size"))


@query(f"WITH {_SIZES} SELECT count(*) FILTER (id % 3 <> 0) AS n, CAST(sum(n) AS BIGINT) AS total_bytes FROM z")
def asset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets without an error and the bytes of all: a long, or the exact decimal where no long holds them, for which the SQL has no result."""
    totals = session.keep(report.asset_totals(_sizes(spark, sf_dir).select(F.col("n").alias("size"), F.when(F.col("id") % 3 == 0, "HTTP 404").alias("error"))))
    within = F.col("total_bytes").between(-(1 << 63), (1 << 63) - 1)
    return totals.select("n", F.col("total_bytes").cast("long").alias("total_bytes")) if totals.select(within).first()[0] else totals


@query(
    """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS key, CASE WHEN l_linenumber = 2 THEN 404 ELSE 200 END AS status, CASE WHEN l_linenumber < 4 THEN CAST(l_quantity * 1000000 AS BIGINT) END AS declared, CAST(l_quantity * 1000000 AS BIGINT) AS size FROM lineitem)
SELECT key, CASE WHEN status >= 400 THEN 'HTTP ' || status WHEN declared > 26214400 THEN 'too large (' || declared // 1024 || ' KB)' WHEN size > 26214400 THEN 'too large (> 25.0 MB)' END AS error,
  CASE WHEN status < 400 AND coalesce(declared, 0) <= 26214400 AND size <= 26214400 THEN size ELSE 0 END AS size, CASE WHEN status < 400 AND coalesce(declared, 0) <= 26214400 AND size <= 26214400 THEN 'assets/h.org/' || key || '.css' ELSE '' END AS path FROM r"""
)
def asset_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key, size = F.col("l_orderkey") * 10 + F.col("l_linenumber"), (F.col("l_quantity") * 1000000).cast("long")
    rows = line.select(key.alias("key"), F.concat(F.lit("https://h.org/"), key.cast("string")).alias("url"), F.when(F.col("l_linenumber") == 2, 404).otherwise(200).alias("status"), F.lit("text/css; charset=utf-8").alias("content_type"), F.when(F.col("l_linenumber") < 4, size).alias("declared"), size.alias("size"))
    return feeds.admit_assets(rows, Scope()).select("key", "error", "size", "path")
