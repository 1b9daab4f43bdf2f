"""What the pages have no case of: every page is given all typed rows of a kind, and each operator works on those of all pages.

Rows that go together (a sheet and what it imports, a site and its maps) carry the page's number in their keys, so pages stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import fixed, html as H, url as U
from webloom.operators import frontier, links as L, state
from webloom.plans.base import SQL_TAGS, each_page, each_page_sql, in_list, query, quoted, sql_attr, sql_canonical, sql_ext, sql_strip, values
from webloom.sources import feeds

VECTORS = [
    (1, "HTTPS://H.com.:443/a//b/../c/?b=2&a=1", None), (2, "http://x.org/es/12?utm_source=feed", None), (3, "https://x.org/en/25#top", None), (4, "/für", "https://m.x.net/en/98"),
    (5, "http://u:p@h:8080/x", None), (6, "http://h/100%25", None), (7, "http://h/a?b&c=", None), (8, "#top", "http://h/x"), (9, "mailto:a@b", None), (10, "ftp://h/x", None), (11, "//h/x", None),
    (12, "//h/x", "https://k/y"), (13, "../up/./x.html?q=a+b&q=%20c", "http://h/a/b/c"), (14, "?page=2", "http://h/a/b"), (15, "", "http://h/a"), (16, "  http://h/a b/í~* \n", None), (17, "http://h:99999/x", None),
    (18, "http:rel", "http://h/a/b"), (19, "https:rel", "http://h/a/b"), (20, "http://h//a//b", None), (21, "..", "http://h/a/b/c"), (22, "http://[2001:db8::1]:8080/x", None), (23, "http://h/a%2Fb%20c", None),
    (24, "http://h/x?z=1&a=%C3%AD&fbclid=9&GCLID=3", None), (25, None, "http://h/"), (26, "JavaScript:void(0)", "http://h/"), (27, "x/", "http://h"), (28, "http://h/a/..", None), (29, "http://h?x=1", None), (30, "/.//x", "http://h/a"), (31, "/a//../b", "http://h/a"), (32, "/..//x", "http://h/a"), (33, "x/../..//y/.", "http://h/a//b/c"), (34, "/../..", "http://h/a"),
]
_VECTORS = "WITH " + each_page_sql("v", "id, raw, base", [(i, r or "", b) for i, r, b in VECTORS]) + ", " + sql_canonical("c", "v")


@query(_VECTORS + " SELECT page_id, id, fetch_url, key FROM c")
def url_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_page(spark, sf_dir, "id int, raw string, base string", VECTORS).select("page_id", "id", U.canonical(F.col("raw"), F.col("base")).alias("c")).select("page_id", "id", F.col("c.fetch_url").alias("fetch_url"), F.col("c.key").alias("key"))


PATHS = [("/a//b/../c/./d", "/a/c/d"), ("//a//b/../c", "//a/c"), ("///a", "/a"), ("/", "/"), ("//", "//"), ("/..", "/"), ("/a/..", "/"), ("/a/b/", "/a/b")]


@query("WITH " + each_page_sql("p", "path, folded", PATHS) + " SELECT * FROM p")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_page(spark, sf_dir, "path string", [(p,) for p, _ in PATHS]).select("page_id", "path", U.fold_path(F.col("path")).alias("folded"))


SEGMENTS = ["a b", "a%20b", "%2e%2e", "CON", "con.txt", "nul", "COM1.a.b", "x<>:y", "a/b", " . ", "", "trail. .", "é" * 60 + ".html", "n" * 95, "ok.tar.gz", "%00x", "a%2Fb"]


@query(
    "WITH " + each_page_sql("s", "segment", [(x,) for x in SEGMENTS]) + rf""",
a AS (SELECT page_id, segment, regexp_replace({sql_strip(r'''regexp_replace(url_decode(segment), '[<>:"|?*\\/\x00-\x1f]', '_', 'g')''')}, '[. ]+$', '') AS p FROM s),
b AS (SELECT page_id, segment, CASE WHEN p = '' THEN '_' WHEN upper(string_split(p, '.')[1]) IN ({in_list(fixed.RESERVED_NAMES)}) THEN '_' || p ELSE p END AS p FROM a),
c AS (SELECT page_id, segment, p, {sql_ext("p")} AS e FROM b), d AS (SELECT *, left(p, length(p) - length(e)) AS stem, greatest(1, 90 - length(e) - 9) AS room FROM c)
SELECT page_id, segment, CASE WHEN strlen(p) > 90 THEN left(stem, CAST(list_max(list_filter(range(0, length(stem) + 1), lambda k: strlen(left(stem, CAST(k AS INT))) <= room)) AS INT)) || '_' || left(sha1(p), 8) || e ELSE p END AS safe FROM d"""
)
def safe_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_page(spark, sf_dir, "segment string", [(x,) for x in SEGMENTS]).select("page_id", "segment", U.safe_segment(F.col("segment")).alias("safe"))


ASSETS = [
    ("https://h.org/a/x.css", "", "assets/h.org/a/x.css"), ("https://h.org/", "text/html", "assets/h.org/index.html"), ("http://h.org:8080/img", "image/png; q=1", "assets/h.org_8080/img.png"), ("https://h.org/d/", "IMAGE/JPEG", "assets/h.org/d.jpg"),
    ("https://h.org/f", "x/unknown", "assets/h.org/f.bin"), ("https://h.org/f", None, "assets/h.org/f.bin"), ("https://h.org/CON/a%20b.js", "", "assets/h.org/_CON/a b.js"),
]


@query("WITH " + each_page_sql("a", "url, content_type, path", ASSETS) + ", q AS (SELECT page_id, 'https://h.org/s.js?v=2', '', 'assets/h.org/s__q' || left(sha1('v=2'), 8) || '.js' FROM pages) SELECT * FROM a UNION ALL SELECT * FROM q")
def asset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [a[:2] for a in ASSETS] + [("https://h.org/s.js?v=2", "")]
    return each_page(spark, sf_dir, "url string, content_type string", rows).select("page_id", "url", "content_type", U.asset_path(F.col("url"), F.col("content_type")).alias("path"))


TYPES = [*fixed.TYPE_EXTENSIONS.items(), ("", ".bin"), (None, ".bin"), (" Text/CSS ; charset=x", ".css"), ("a/b", ".bin")]


@query("WITH " + each_page_sql("t", "content_type, ext", TYPES) + " SELECT * FROM t")
def content_type_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_page(spark, sf_dir, "content_type string", [(t,) for t, _ in TYPES]).select("page_id", "content_type", U.type_extension(F.col("content_type")).alias("ext"))


RELATIVE = [
    ("pages/h/b/index.html", "pages/h/a/índex.html", "../a/%C3%ADndex.html"), ("index.html", "pages/h/x.html", "pages/h/x.html"), ("pages/h/x.html", "index.html", "../../index.html"), ("a/b.html", "a/b.html", "b.html"),
    ("a/b/c.html", "a/d e/f(1)+g.css", "../d%20e/f(1)+g.css"), ("pages/h/a/index.html", "assets/h/x%20y.css", "../../../assets/h/x%2520y.css"),
]


@query("WITH " + each_page_sql("r", "here, there, link", RELATIVE) + " SELECT * FROM r")
def relative_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_page(spark, sf_dir, "here string, there string", [r[:2] for r in RELATIVE]).select("page_id", "here", "there", U.relative_link(F.col("here"), F.col("there")).alias("link"))


DOCS = [
    (1, "https://h.org/p/a.html", '<html><head><base href="/root/"><link rel="stylesheet" href="s.css"><link rel=canonical href="/c"><link href="f.ico" rel="shortcut icon"><meta http-equiv="Refresh" content="5; URL=next.html"></head><body><a href="one.html">1</a><img src="i.png" srcset="i2.png 2x, i3.png 300w"><style>@import "m.css"; p{background:url(bg.png)}</style></body></html>'),
    (2, "https://h.org/q", '<body><area href="/two"><form action="/go?x=1&amp;y=2"></form><iframe src="/three"></iframe><p style="background:url(\'../k.gif\')">x</p><video src="v.mp4" poster="v.jpg"></video><script src="https://cdn.x/j.js" integrity="sha" crossorigin="anonymous"></script></body>'),
    (3, "https://h.org/r", '<!-- <a href="/no"> --><script>var a = "<a href=\'/no2\'>";</script><a href="mailto:x@y">m</a><a href="#f">f</a><a name="z">z</a><img data-src="lazy.png"><img src="" data-original="o.png"><link as="font" href="f.woff2" rel="x"><a href="/ok" title="a > b">ok</a><img src="data:image/png;base64,xx">'),
]
_DOCS = "WITH " + each_page_sql("typed", "doc, url, html", DOCS) + ", docs AS (SELECT page_id * 10 + doc AS page_id, url, html FROM typed)" + ", " + SQL_TAGS.replace("{source}", "docs")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed documents of every page; a document's number is ten times the page's and its own."""
    rows = each_page(spark, sf_dir, "doc bigint, url string, html string", DOCS)
    return rows.select(_doc_id(), "url", "html")


def _doc_id() -> F.Column:
    return (F.col("page_id") * 10 + F.col("doc")).alias("page_id")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("page_id", "url", F.posexplode(H.tags(F.col("html"))).alias("p", "tag")).withColumn("pos", F.col("p") + 1)


@query("WITH e(doc, base) AS (VALUES (1, 'https://h.org/root/'), (2, 'https://h.org/q'), (3, 'https://h.org/r')) SELECT page_id * 10 + doc AS page_id, base FROM pages, e")
def base_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("page_id", H.base_url(F.col("html"), F.col("url")).alias("base"))


@query("WITH e(doc, pos, key) AS (VALUES (1, 0, 'https://h.org/root/one.html'), (1, 1, 'https://h.org/root/next.html'), (2, 0, 'https://h.org/two'), (2, 1, 'https://h.org/go?x=1&y=2'), (2, 2, 'https://h.org/three'), (3, 0, 'https://h.org/ok')) SELECT page_id * 10 + doc AS page_id, pos, key FROM pages, e")
def literal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_links(_docs(spark, sf_dir))


@query(_DOCS + f""" SELECT CAST(page_id AS BIGINT) AS page_id, pos, coalesce(nullif({sql_attr("tag", "src")}, ''), nullif({sql_attr("tag", "data-src")}, ''), nullif({sql_attr("tag", "data-original")}, '')) AS src FROM tags WHERE name = 'img'""")
def lazy_src_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).where(H.tag_name(F.col("tag")) == "img").select("page_id", F.col("pos").cast("long").alias("pos"), H.lazy_src(F.col("tag")).alias("src"))


#: A tag, an attribute, its value: quotes, look-alikes and references.
ATTRS = [
    ('<a title="href=/evil" href="/ok">', "href", "/ok"), ("<a data-href=/no href = '/yes'>", "href", "/yes"), ('<a href="/a"href="/b">', "href", "/a"), ("<a title='x href=\"/no\"'>", "href", None), ("<a href>", "href", None), ("<a href=>", "href", None),
    ("<a HREF=/Up/Down>", "href", "/Up/Down"), ('<a href="&#47;x&eacute;&amp;y&lt;">', "href", "/xé&y<"), ('<a href="?a=1&copy=2&reg">', "href", "?a=1&copy=2®"), ('<a href="&#x1F600;&#0;&#xD800;&nosuch;">', "href", "😀\ufffd\ufffd&nosuch;"), ("<a/href=/s/>", "href", "/s/"), ("<img src=i.png alt=src=no>", "alt", "src=no"), ('<a b="1" c href="">', "href", ""),
]


@query("WITH " + each_page_sql("a", "tag, name, value", ATTRS) + " SELECT page_id, tag, value FROM a")
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each_page(spark, sf_dir, "tag string, name string", [a[:2] for a in ATTRS])
    return rows.select("page_id", "tag", F.when(F.col("name") == "alt", H.attr(F.col("tag"), "alt")).otherwise(H.attr(F.col("tag"), "href")).alias("value"))


RELS = [
    ('<link rel="stylesheet" href=a>', "asset"), ('<link rel="Alternate Icon" href=a>', "asset"), ('<link rel="shortcut icon" href=a>', "asset"), ('<link rel="alternate" type="x" href=a>', "absolute"), ('<link rel="x" as="font" href=a>', "asset"),
    ('<link rel="x" type="t" href=a>', "asset"), ('<link rel="x" href=a>', "absolute"), ("<link href=a>", "absolute"), ('<link rel="preconnect" href=a>', "absolute"), ('<link rel="x" as="" href=a>', "absolute"),
]


@query("WITH " + each_page_sql("r", "tag, kind", RELS) + " SELECT * FROM r")
def link_rel_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_page(spark, sf_dir, "tag string", [(t,) for t, _ in RELS]).select("page_id", "tag", H.link_kind(F.col("tag")).alias("kind"))


SETS = ["a.png 1x, b.png 2x", " one.jpg ", "", "x,y z w,,", "a,b.png 300w"]


@query(
    "WITH " + each_page_sql("s", "value", [(x,) for x in SETS]) + r""", c AS (SELECT page_id, value, list_filter(list_transform(string_split(value, ','), lambda x: trim(x)), lambda x: x <> '') AS c FROM s),
e AS (SELECT page_id, value, c, unnest(range(1, len(c) + 1)) AS pos FROM c) SELECT page_id, value, CAST(pos - 1 AS INT) AS pos, string_split(c[pos], ' ')[1] AS url, CASE WHEN contains(c[pos], ' ') THEN regexp_replace(c[pos], '^\S+\s+', '') ELSE '' END AS descriptor FROM e"""
)
def srcset_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each_page(spark, sf_dir, "value string", [(x,) for x in SETS])
    return rows.select("page_id", "value", F.posexplode(H.srcset(F.col("value"))).alias("pos", "e")).select("page_id", "value", "pos", "e.url", "e.descriptor")


REFRESH = [("5; url=/x", "/x"), ("0;URL = y.html ", "y.html"), ("5", None), ("x; url=/z", None), (" 3 ; url=a b", "a b"), ("1;url=", None)]


@query("WITH " + each_page_sql("r", "content, target", REFRESH) + " SELECT * FROM r")
def meta_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_page(spark, sf_dir, "content string", [(c,) for c, _ in REFRESH]).select("page_id", "content", H.meta_refresh(F.col("content")).alias("target"))


ASSET_KEYS = [
    (1, "https://h.org/root/i.png"), (1, "https://h.org/root/i2.png"), (1, "https://h.org/root/i3.png"), (1, "https://h.org/root/s.css"), (1, "https://h.org/root/f.ico"), (1, "https://h.org/root/m.css"), (1, "https://h.org/root/bg.png"),
    (2, "https://cdn.x/j.js"), (2, "https://h.org/v.mp4"), (2, "https://h.org/v.jpg"), (2, "https://h.org/k.gif"), (3, "https://h.org/f.woff2"),
]
_ASSET_KEYS = "WITH " + each_page_sql("typed", "doc, key", ASSET_KEYS) + ", k AS (SELECT page_id * 10 + doc AS page_id, key FROM typed)"


@query(_ASSET_KEYS + " SELECT CAST(page_id AS BIGINT) AS page_id, key FROM k")
def page_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_assets(_docs(spark, sf_dir)).select("page_id", "key")


@query(_ASSET_KEYS + " SELECT CAST(page_id AS BIGINT) AS page_id, key, CASE WHEN key LIKE '%.png' THEN 'assets/' || sha1(key) END AS path, CASE WHEN key LIKE '%.png' THEN 'local' ELSE 'remote' END AS offline FROM k")
def asset_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = L.page_assets(_docs(spark, sf_dir))
    have = refs.where("key LIKE '%.png'").select("key").distinct().withColumn("path", F.concat(F.lit("assets/"), F.sha1("key")))
    return L.resolve_links(refs, have).select("page_id", "key", "path", "offline")


CSS = [
    (1, "p{background:url( 'a.png' )} q{b:URL(b.png)} @import url(c.css); @import 'd.css' screen;"), (2, "no refs"), (3, '@import "e.css"; x{y:url("f.svg#i")} z{w:url(data:xx)}'), (4, "bad{u:url('a\")}"),
]
_CSS = "WITH " + each_page_sql("c", "id, css", CSS)


@query(_CSS + r""" SELECT page_id, id, array_to_string(list_transform(regexp_extract_all(css, '(?i)url\(\s*(?:''[^''")]+?''|"[^''")]+?"|[^''")]+?)\s*\)'), lambda u: trim(regexp_replace(regexp_replace(u, '(?i)^url\(\s*[''"]?', ''), '[''"]?\s*\)$', ''))), ' ') AS urls FROM c""")
def css_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_page(spark, sf_dir, "id int, css string", CSS).select("page_id", "id", F.array_join(H.css_urls(F.col("css")), " ").alias("urls"))


@query(_CSS + r""" SELECT page_id, id, array_to_string(regexp_extract_all(css, '(?i)@import\s+(?:url\(\s*)?[''"]?([^''")\s;]+)', 1), ' ') AS imports FROM c""")
def css_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_page(spark, sf_dir, "id int, css string", CSS).select("page_id", "id", F.array_join(H.css_imports(F.col("css")), " ").alias("imports"))


#: A chain of six sheets, a cycle and a leaf: (sheet, what it names).
SHEETS = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("b", "a"), ("a", "x.png"), ("z", "z")]


@query(
    "WITH RECURSIVE " + each_page_sql("t", "a, b", SHEETS) + """, s AS (SELECT page_id || ':' || a AS src, page_id || ':' || b AS dst FROM t), r AS (SELECT page_id || ':a' AS key, 0 AS depth FROM pages UNION SELECT s.dst, r.depth + 1 FROM r JOIN s ON s.src = r.key WHERE r.depth < 4)
SELECT key, min(depth) AS depth FROM r GROUP BY key"""
)
def css_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a style sheet leads to within four steps; cycles end at what was seen."""
    from webloom.functions.scope import Scope

    own = lambda c: F.concat(F.col("page_id").cast("string"), F.lit(":"), F.col(c)).alias(c)
    edges = each_page(spark, sf_dir, "src string, dst string", SHEETS).select(own("src"), own("dst"), F.lit(0).alias("pos"))
    seeds = each_page(spark, sf_dir, "key string", [("a",)]).select(own("key"), F.col("page_id").alias("seq"))
    found, _ = frontier.crawl(edges, seeds, Scope(max_depth=4, max_pages=0))
    return found.select("key", "depth")


#: Style sheets in a circle and a chain, and what becomes of them when all but the last are assets.
SHEET_ROWS = [
    ("https://h/a.css", "assets/h/a.css", "@import 'b.css'; p{background:url(i/x.png)}", '@import url("b.css"); p{background:url("i/x.png")}'), ("https://h/b.css", "assets/h/b.css", '@import url("d/c.css"); @import "a.css";', '@import url("d/c.css"); @import url("a.css");'),
    ("https://h/d/c.css", "assets/h/d/c.css", "q{b:url( '../i/x.png' )} r{c:url(data:xx)} s{d:url(gone.png)}", 'q{b:url("../i/x.png")} r{c:url(data:xx)} s{d:url("https://h/d/gone.png")}'),
]


def _at_page(c: str) -> F.Column:
    """The host of a typed URL, one for each page."""
    return F.replace(F.col(c), F.lit("https://h/"), F.concat(F.lit("https://h"), F.col("page_id").cast("string"), F.lit("/"))).alias(c)


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each_page(spark, sf_dir, "key string, path string, css string", [s[:3] for s in SHEET_ROWS])
    return rows.select(_at_page("key"), "path", "css", _at_page("key").alias("url"))


@query("WITH " + each_page_sql("s", "key, path, css, out", SHEET_ROWS) + " SELECT replace(key, 'https://h/', 'https://h' || page_id || '/') AS key, replace(out, 'https://h/', 'https://h' || page_id || '/') AS css FROM s")
def css_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.operators import rewrite

    assets = _sheets(spark, sf_dir).select("key", "path").unionByName(each_page(spark, sf_dir, "key string, path string", [("https://h/i/x.png", "assets/h/i/x.png")]).select(_at_page("key"), "path"))
    return rewrite.rewrite_sheets(_sheets(spark, sf_dir), assets).select("key", "css")


@query("WITH " + each_page_sql("c", "key, depth", [("https://h/a.css", 0), ("https://h/b.css", 1), ("https://h/i/x.png", 1), ("https://h/d/c.css", 2), ("https://h/d/gone.png", 3)]) + " SELECT replace(key, 'https://h/', 'https://h' || page_id || '/') AS key, depth FROM c")
def css_sheet_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from webloom.operators import rewrite

    return rewrite.sheet_closure(_sheets(spark, sf_dir), _sheets(spark, sf_dir).where("key LIKE '%/a.css'").select("key"))


TAGS_IN = ['<script src="a" integrity="x" crossorigin="anonymous"></script>', "<link href=a crossorigin rel=b>", '<LINK integrity=\'q\' href="a">', '<p integrity="x">', "<script>var integrity = 1</script>", '<script crossorigin integrity="a" src=x></script>']
TAGS_OUT = ['<script src="a"></script>', "<link href=a rel=b>", '<LINK href="a">', '<p integrity="x">', "<script>var integrity = 1</script>", "<script src=x></script>"]


@query("WITH " + each_page_sql("t", "html, stripped", list(zip(TAGS_IN, TAGS_OUT, strict=True))) + " SELECT * FROM t")
def integrity_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_page(spark, sf_dir, "html string", [(t,) for t in TAGS_IN]).select("page_id", "html", H.strip_integrity(F.col("html")).alias("stripped"))


MAPS = [
    ("s", 0, "https://s/sitemap.xml", "<sitemapindex><sitemap><loc> https://s/one.xml </loc></sitemap><sitemap><loc>https://s/two.xml</loc></sitemap><sitemap><loc>https://s/gone.xml</loc></sitemap></sitemapindex>"),
    ("s", None, "https://s/one.xml", "<urlset><url><loc>https://s/a?x=1&amp;y=2</loc></url><url><LOC>\nhttps://s/b</LOC></url></urlset>"), ("s", None, "https://s/two.xml", "<urlset><url><loc>https://s/c</loc></url></urlset>"),
    ("t", 0, "https://t/m.xml", "<urlset><url><loc>https://t/a</loc></url></urlset>"), ("t", 1, "https://t/sitemap.xml", "<urlset></urlset>"),
]
LOCS = [("s", 0, "https://s/a?x=1&y=2"), ("s", 1, "https://s/b"), ("s", 2, "https://s/c"), ("t", 0, "https://t/a")]


@query("WITH " + each_page_sql("l", "site, pos, url", LOCS) + " SELECT page_id || site AS site, pos, url FROM l")
def sitemap_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = each_page(spark, sf_dir, "site string, seq int, url string, body string", MAPS)
    return feeds.sitemap_urls(maps.withColumn("site", F.concat(F.col("page_id").cast("string"), "site")))


ROBOTS = [
    ("https://h", "# all\nUser-agent: *\nDisallow: /private\nAllow: /private/ok\nDisallow:\n\nUser-agent: other\nDisallow: /\nSitemap: https://h/s.xml\n"),
    ("https://k", "User-agent: *\nDisallow: /\n\nUser-agent: Mozilla\nUser-agent: x\nAllow: /a\nDisallow: /\n"), ("https://e", ""),
]
TARGETS = [("https://h", "/private/x", False), ("https://h", "/private/ok", False), ("https://h", "/pub", True), ("https://k", "/a/b", True), ("https://k", "/b", False), ("https://e", "/", True), ("https://none", "/z", True)]


@query("WITH " + each_page_sql("t", "origin, target, allowed", TARGETS) + " SELECT origin || page_id AS origin, target, allowed FROM t")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat("origin", F.col("page_id").cast("string")).alias("origin")
    rules = feeds.robots_rules(each_page(spark, sf_dir, "origin string, body string", ROBOTS).select(own, "body"))
    return frontier.allowed(each_page(spark, sf_dir, "origin string, target string", [t[:2] for t in TARGETS]).select(own, "target"), rules)


COOKIES = [("gate", 0, 0, "a", "1", "h"), ("gate", 0, 1, "a", "2", "h"), ("login", 1, 0, "a", "3", "k"), ("live", 2, 0, "b", "4", "h"), ("gate", 0, 2, "c", "5", "h"), ("live", 2, 1, "c", "6", "h"), ("login", 1, 5, "c", "7", "h")]


@query("WITH " + each_page_sql("c", "source, priority, pos, name, value, domain", COOKIES) + " SELECT name || page_id AS name, value, domain, source FROM (SELECT *, row_number() OVER (PARTITION BY page_id, name ORDER BY priority DESC, pos DESC) AS k FROM c) WHERE k = 1")
def cookie_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each_page(spark, sf_dir, "source string, priority int, pos int, name string, value string, domain string", COOKIES)
    return feeds.merge_cookies(rows.withColumn("name", F.concat("name", F.col("page_id").cast("string"))))


JAR = [("h", "a", "1", None, None, "99"), ("h", "b", "2", "/x", "", "soon"), ("h", "c", "3", "/", "k", None)]


@query("WITH " + each_page_sql("j", "host, name, value, path, domain, expiry", JAR) + " SELECT host || page_id AS host, name, value, coalesce(path, '/') AS path, coalesce(nullif(domain, ''), host || page_id) AS domain, TRY_CAST(expiry AS BIGINT) AS expiry FROM j")
def cookie_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each_page(spark, sf_dir, "host string, name string, value string, path string, domain string, expiry string", JAR)
    return feeds.usable_cookies(rows.withColumn("host", F.concat("host", F.col("page_id").cast("string")))).drop(*feeds.COOKIE_FLAGS)


def _message(method: str, kind: str, url: str, status: int) -> str:
    return '{"message":{"method":"%s","params":{"type":"%s","response":{"url":"%s","status":%d,"mimeType":"text/html"}}}}' % (method, kind, url, status)


LOG = [
    (1, 0, _message("Network.responseReceived", "Document", "http://h/a#x", 301)), (1, 1, _message("Network.responseReceived", "Document", "http://h/b", 200)), (1, 2, _message("Network.responseReceived", "Image", "http://h/i", 404)),
    (1, 3, _message("Network.responseReceived", "Document", "http://ad/", 500)), (2, 0, _message("Network.responseReceived", "Document", "http://z/1", 200)), (2, 1, _message("Network.responseReceived", "Document", "http://z/2", 204)),
    (3, 0, _message("Network.requestWillBeSent", "Document", "http://h/c", 200)), (3, 1, "broken"),
]
WANTED = [(1, "http://h/a", "http://h/b#top"), (2, "http://h/q", "http://h/q"), (3, "http://h/c", "http://h/c")]


@query("WITH " + each_page_sql("e", "doc, status, mime", [(1, 200, "text/html"), (2, 204, "text/html"), (3, None, "")]) + " SELECT page_id * 10 + doc AS page_id, status, mime FROM e")
def status_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = each_page(spark, sf_dir, "doc int, pos int, message string", LOG).select(_doc_id(), "pos", "message")
    return feeds.status_from_log(log, each_page(spark, sf_dir, "doc int, url string, final_url string", WANTED).select(_doc_id(), "url", "final_url"))


GATE = [
    ("auto", 0, 0, True, "auto"), ("enter", 0, 0, True, "enter"), ("skip", 0, 0, True, "s"), ("skip", 1, 0, True, "enter"), ("many", 0, 0, True, "auto"), ("many", 1, 0, True, "auto"), ("many", 2, 0, True, "auto"), ("many", 3, 1, True, "enter"), ("off", 0, 0, False, "auto"),
]
GATE_OUT = [
    ("auto", 0, True, 1, 1, False), ("enter", 0, True, 1, 1, False), ("skip", 0, False, 1, 0, True), ("skip", 1, False, 1, 0, True), ("many", 0, True, 1, 1, False), ("many", 1, True, 1, 1, False), ("many", 2, True, 1, 1, False), ("many", 3, True, 2, 2, False), ("off", 0, False, 0, 0, False),
]


@query("WITH " + each_page_sql("g", "session, seq, returned, prompts, solved, abandoned", GATE_OUT) + " SELECT session || page_id AS session, CAST(seq AS BIGINT) AS seq, returned, prompts, solved, abandoned FROM g")
def gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each_page(spark, sf_dir, "session string, seq int, seen_epoch int, enabled boolean, action string", GATE)
    return state.gate_events(rows.withColumn("session", F.concat("session", F.col("page_id").cast("string"))))


@query("SELECT page_id, 'https://' || page_id AS key, 200 AS status, CAST(page_id % 4 AS INT) AS depth, CASE WHEN page_id % 7 = 0 THEN 'timeout' END AS error FROM pages")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to a manifest for each host, and back."""
    from pyspark.sql import types as T

    from webloom.functions.scope import Scope

    src = spark.read.parquet(f"{sf_dir}/pages.parquet")
    null = lambda kind: F.lit(None).cast(kind)
    rows = src.select(
        F.concat(F.lit("https://"), F.col("page_id").cast("string")).alias("key"), "url", F.col("url").alias("final_url"), F.lit("p").alias("path"), F.lit("r").alias("raw"), F.lit("t").alias("title"), F.lit(200).alias("status"),
        F.expr("int(page_id % 4)").alias("depth"), null("string").alias("parent"), F.array(F.lit("a")).alias("links"), F.length("html").cast("long").alias("bytes"), F.lit("2024-01-01T00:00:00+00:00").alias("fetched_at"), F.when(F.col("page_id") % 7 == 0, "timeout").alias("error"),
    )
    rows = rows.withColumn("site", U.host_of(F.col("url")))
    asset = rows.select("site", "key", "url", "path", F.lit("text/css").alias("content_type"), F.col("bytes").alias("size"), "error")
    starts = rows.groupBy("site").agg(F.min("key").alias("start_key")).withColumn("start_url", F.col("start_key"))
    text = feeds.to_manifests(rows, asset, rows.select("site", "key", "depth"), starts, Scope(), "a", "b")
    back = text.select(F.from_json("value", T._parse_datatype_string(feeds.MANIFEST)).alias("m")).select("m.*")
    return feeds.manifest_pages(back).select(F.substring("key", 9, 20).cast("long").alias("page_id"), "key", "status", "depth", "error")


__all__ = ["quoted"]
