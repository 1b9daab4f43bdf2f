"""Inputs beside pages: sitemaps, robots files, cookies, browser logs, manifests, asset responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import fixed, html as H, url as U
from webloom.functions.scope import Scope

#: Child maps of a sitemap index that are followed, and URLs that are taken of a site.
CHILD_MAPS, SITEMAP_URLS = 50, 5000

PAGE = "struct<url:string,final_url:string,path:string,raw:string,title:string,status:int,depth:int,parent:string,links:array<string>,bytes:bigint,fetched_at:string,error:string>"
ASSET = "struct<url:string,path:string,content_type:string,size:bigint,error:string>"
SETTINGS = "struct<max_depth:int,max_pages:int,include_subdomains:boolean,path_prefix:string,download_assets:boolean,respect_robots:boolean,workers:int>"
MANIFEST = f"version int, start_url string, start_key string, created string, finished string, settings {SETTINGS}, pages map<string,{PAGE}>, assets map<string,{ASSET}>, not_crawled map<string,int>"
COOKIE = "struct<name:string,value:string,path:string,domain:string,secure:boolean,httpOnly:boolean,expiry:bigint,sameSite:string>"
_LOG = "struct<message:struct<method:string,params:struct<type:string,response:struct<url:string,status:int,mimeType:string>>>>"


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """(name, body) of text files, gzip told by its first bytes; broken gzip data give an empty body, broken UTF-8 is replaced."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content")

    def text(batches):
        import gzip
        import zlib

        import pyarrow as pa

        def plain(x: bytes | None) -> bytes:
            try:
                return gzip.decompress(x) if x and x[:2] == b"\x1f\x8b" else x or b""
            except (OSError, EOFError, zlib.error):
                return b""

        for batch in batches:
            raw = [plain(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], names=["name", "body"])

    return files.mapInArrow(text, "name string, body string")


def locations(body: Column) -> Column:
    """URLs that a sitemap lists."""
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: H.unescape(x))


def is_index(body: Column) -> Column:
    return F.contains(F.lower(F.substring(body, 1, 2000)), F.lit("<sitemapindex"))


def sitemap_urls(maps: DataFrame, limit: int = SITEMAP_URLS) -> DataFrame:
    """(site, pos, url) from ``maps`` (site, seq, url, body): the pages of a site's maps, an index's children one level down.

    ``seq`` is the order in which a site names its maps; maps that no index and no robots file names have none. A map that is named more
    than once is read once, where it is named first; children come behind all maps that the site names itself.
    """
    body = F.coalesce("body", F.lit(""))
    named = maps.where("seq IS NOT NULL").groupBy("site", "url").agg(F.min("seq").alias("seq"), F.min_by(body, "seq").alias("body"))
    place = lambda level, a, b: F.struct(F.lit(level).alias("level"), F.col(a).cast("int").alias("a"), b.cast("int").alias("b")).alias("order")
    plain = named.where(~is_index(F.col("body"))).select("site", place(0, "seq", F.lit(0)), "body")
    kids = named.where(is_index(F.col("body"))).select("site", "seq", F.posexplode(F.slice(locations(F.col("body")), 1, CHILD_MAPS)).alias("b", "url"))
    kids = kids.groupBy("site", "url").agg(F.min(place(1, "seq", F.col("b"))).alias("order")).join(named.select("site", "url"), ["site", "url"], "left_anti")
    texts = maps.groupBy("site", "url").agg(F.max(body).alias("body"))
    below = kids.join(texts, ["site", "url"]).where(~is_index(F.col("body"))).select("site", "order", "body")
    rows = plain.unionByName(below).select("site", "order", F.posexplode(F.slice(locations(F.col("body")), 1, limit)).alias("c", "url"))
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy("site").orderBy("order", "c")) - 1)
    return ranked.where(F.col("pos") < limit).select("site", "pos", "url")


def robots_sitemaps(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


def robots_rules(robots: DataFrame, agent: str = "mozilla") -> DataFrame:
    """(origin, seq, allow, prefix) from ``robots`` (origin, body): rules of the first group that names the agent, else of ``*``.

    As in the standard parser: a group is agent lines and then rules; a blank line ends a group that has rules; an empty
    disallow allows everything; prefixes are compared after percent encoding.
    """
    lines = F.transform(F.split("body", r"\r\n|\r|\n"), lambda x: U.strip(F.regexp_replace(x, "#.*$", "")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(U.strip(F.regexp_extract(x, "^([^:]*):", 1))).alias("k"), U.percent_decode(U.strip(F.regexp_extract(x, "^[^:]*:(.*)$", 1))).alias("v"), (x == "").alias("blank")))
    kind = "struct<group:int,state:int,out:array<struct<group:int,k:string,v:string>>>"
    start = F.struct(F.lit(0).alias("group"), F.lit(0).alias("state"), F.array().cast("array<struct<group:int,k:string,v:string>>").alias("out")).cast(kind)

    def step(s: Column, p: Column) -> Column:
        # state 0: between groups, 1: agents were read, 2: rules were read
        agent_line, rule = p["k"] == "user-agent", p["k"].isin("allow", "disallow")
        group = F.when(agent_line & (s["state"] != 1), s["group"] + 1).otherwise(s["group"])
        state = F.when(p["blank"], F.lit(0)).when(agent_line, F.lit(1)).when(rule & (s["state"] != 0), F.lit(2)).otherwise(s["state"])
        keep = agent_line | (rule & (s["state"] != 0))
        return F.struct(group.alias("group"), state.alias("state"), F.when(keep, F.concat(s["out"], F.array(F.struct(group.alias("group"), p["k"].alias("k"), p["v"].alias("v"))))).otherwise(s["out"]).alias("out")).cast(kind)

    flat = robots.select("origin", F.posexplode(F.aggregate(pairs, start, step)["out"]).alias("seq", "r")).select("origin", "seq", "r.*")
    agents = flat.where("k = 'user-agent'").select("origin", "group", F.lower(F.col("v")).alias("a"))
    named = agents.where((F.col("a") == "*") | F.contains(F.lit(agent.split("/")[0].lower()), F.col("a"))).withColumn("rank", F.when(F.col("a") == "*", 1).otherwise(0))
    chosen = named.groupBy("origin").agg(F.min(F.struct("rank", "group")).alias("c")).select("origin", F.col("c.group").alias("group"))
    rules = flat.where("k <> 'user-agent'").join(chosen, ["origin", "group"])
    return rules.select("origin", "seq", ((F.col("k") == "allow") | (F.col("v") == "")).alias("allow"), F.when(F.col("v") == "", "/").otherwise(U.percent_encode(F.col("v"), ["/"])).alias("prefix"))


def status_from_log(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, status, mime) of the document itself from ``log`` (page_id, pos, message) for ``wanted`` (page_id, url, final_url).

    The latest document response for the asked or the final URL, else the last document response.
    """
    m = F.from_json("message", T._parse_datatype_string(_LOG))["message"]
    docs = log.select("page_id", "pos", m.alias("m")).where("m.method = 'Network.responseReceived' AND m.params.type = 'Document'")
    rows = docs.join(wanted, "page_id").select("page_id", "pos", F.col("m.params.response.status").alias("status"), F.coalesce("m.params.response.mimeType", F.lit("")).alias("mime"), U.strip_fragment(F.col("m.params.response.url")).isin(U.strip_fragment(F.col("url")), U.strip_fragment(F.col("final_url"))).alias("hit"))
    best = rows.groupBy("page_id").agg(F.max_by(F.struct("status", "mime"), F.struct("hit", "pos")).alias("r"))
    return wanted.select("page_id").join(best, "page_id", "left").select("page_id", F.col("r.status").alias("status"), F.coalesce("r.mime", F.lit("")).alias("mime"))


#: Fields of a cookie that a browser takes; anything else in a file is left out.
COOKIE_FLAGS = ["secure", "httpOnly", "sameSite"]


def read_cookies(spark: SparkSession, path: str) -> DataFrame:
    """Cookies of JSON files, each a list, one cookie a line, or one cookie over many lines; what is no cookie gives no rows."""
    text = F.col("value")
    by_line = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.from_json(x, COOKIE))
    lines = F.filter(by_line, lambda c: c["name"].isNotNull())
    some = F.when(text.rlike(r"^[\s\ufeff]*\["), F.transform(F.from_json(text, "array<string>"), lambda x: F.from_json(x, COOKIE))).when(F.size(lines) > 0, lines).otherwise(F.array(F.from_json(text, COOKIE)))
    rows = spark.read.text(path, wholetext=True).select(F.explode(some).alias("c")).select("c.*")
    return rows.where("name IS NOT NULL AND value IS NOT NULL")


def usable_cookies(cookies: DataFrame) -> DataFrame:
    """Cookies with the known fields; an expiry that is no number is dropped, the domain and path get defaults from ``host``."""
    flags = [F.col(c) if c in cookies.columns else F.lit(None).cast("string" if c == "sameSite" else "boolean").alias(c) for c in COOKIE_FLAGS]
    domain = F.coalesce(F.nullif(F.col("domain"), F.lit("")), "host").alias("domain")
    return cookies.select("host", "name", "value", F.coalesce("path", F.lit("/")).alias("path"), domain, F.expr("try_cast(expiry AS bigint)").alias("expiry"), *flags)


def merge_cookies(cookies: DataFrame) -> DataFrame:
    """One cookie of each name from (source, priority, pos, name, value, domain): the latest of the highest priority."""
    return cookies.groupBy("name").agg(F.max_by(F.struct("value", "domain", "source"), F.struct("priority", "pos")).alias("c")).select("name", "c.*")


def admit_assets(responses: DataFrame, scope: Scope) -> DataFrame:
    """Asset rows from ``responses`` (key, url, status, content_type, declared, size): error, path and size of each."""
    most = scope.max_asset_bytes
    error = (
        F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(F.col("declared") > most, F.concat(F.lit("too large ("), F.floor(F.col("declared") / 1024).cast("string"), F.lit(" KB)")))
        .when(F.col("size") > most, F.lit(f"too large (> {scope.max_asset_mb} MB)"))
    )
    rows = responses.withColumn("error", error)
    ok = F.col("error").isNull()
    return rows.select("key", "url", F.when(ok, U.asset_path(F.col("url"), F.col("content_type"))).otherwise("").alias("path"), F.when(F.col("status") >= 400, "").otherwise(F.coalesce("content_type", F.lit(""))).alias("content_type"), F.when(ok, F.col("size")).otherwise(0).cast("long").alias("size"), "error")


def is_html(content_type: Column) -> Column:
    first = F.lower(U.strip(F.regexp_extract(F.coalesce(content_type, F.lit("")), "^([^;]*)", 1)))
    return (first == "") | first.rlike("^(" + "|".join(t.replace("+", "[+]") for t in fixed.HTML_TYPES) + ")")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as rows. A file that is cut off or no manifest gives none, so a crawl that would go on from it starts afresh."""
    rows = spark.read.schema(MANIFEST + ", _corrupt_record string").option("multiLine", True).json(path)
    return rows.where("_corrupt_record IS NULL AND version IS NOT NULL").drop("_corrupt_record")


def manifest_pages(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("pages").alias("key", "p")).select("key", "p.*")


def manifest_assets(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("assets").alias("key", "a")).select("key", "a.*")


def to_manifests(pages: DataFrame, assets: DataFrame, pending: DataFrame, starts: DataFrame, scope: Scope, created: str, finished: str) -> DataFrame:
    """(site, value): each site's manifest as JSON, from tables that have ``site`` beside ``key``; ``starts``: (site, start_url, start_key).

    A manifest is one document, so a site's rows meet in it; other sites' don't.
    """
    names = lambda kind: [f.name for f in T._parse_datatype_string(kind).fields]

    def entries(df: DataFrame, value: Column, name: str) -> DataFrame:
        return df.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("key", value))).alias(name))

    p = entries(pages, F.struct(*names(PAGE)).cast(PAGE), "pages")
    a = entries(assets, F.struct(*names(ASSET)).cast(ASSET), "assets")
    n = entries(pending, F.col("depth").cast("int"), "not_crawled")
    values = (("max_depth", scope.max_depth), ("max_pages", scope.max_pages), ("include_subdomains", scope.include_subdomains), ("path_prefix", scope.path_prefix), ("download_assets", True), ("respect_robots", True), ("workers", 1))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in values]).alias("settings")
    rows = starts.join(p, "site", "left").join(a, "site", "left").join(n, "site", "left")
    head = [F.lit(1).alias("version"), "start_url", "start_key", F.lit(created).alias("created"), F.lit(finished).alias("finished")]
    return rows.select("site", F.to_json(F.struct(*head, settings, "pages", "assets", "not_crawled")).alias("value"))
