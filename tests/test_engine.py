"""Frontier, paths, rewriting and state on small cases."""

from pyspark.sql import functions as F

from webloom.functions import html as H, walls
from webloom.functions.scope import Scope
from webloom.operators import frontier, links, report, rewrite, state


def test_budget_and_depth(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("c", "e", 1), ("d", "a", 0)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("a", 0)], "key string, seq bigint")
    got, rest = frontier.crawl(edges, seeds, Scope(max_depth=3, max_pages=4))
    assert {r.key: (r.depth, r.parent) for r in got.collect()} == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b")}
    assert [tuple(r) for r in rest.collect()] == [("e", 2)]
    got, rest = frontier.crawl(edges, seeds, Scope(max_depth=1, max_pages=0))
    assert {r.key for r in got.collect()} == {"a", "b", "c"} and {r.key for r in rest.collect()} == {"d", "e"}


def test_walled_pages_lead_nowhere_and_sitemap_comes_first(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("b", "c", 0)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("a", 0)], "key string, seq bigint")
    open_pages = spark.createDataFrame([("a",)], "key string")
    site = spark.createDataFrame([("s", 0)], "key string, seq bigint")
    got, _ = frontier.crawl(edges, seeds, Scope(max_depth=3, max_pages=0), open_pages, site)
    assert {r.key: (r.depth, r.seq) for r in got.collect()} == {"a": (0, 0), "s": (1, 0), "b": (1, 1)}
    got, _ = frontier.crawl(edges, seeds, Scope(max_depth=0, max_pages=0), None, site)
    assert {r.key for r in got.collect()} == {"a", "s"}


def test_paths_clash_without_case(spark):
    rows = spark.createDataFrame([(0, "k1", "p/a.html"), (1, "k2", "P/A.html"), (2, "k3", "p/b.html")], "seq int, key string, path string")
    got = {r.key: r.path for r in links.allocate_paths(rows).collect()}
    assert got["k1"] == "p/a.html" and got["k3"] == "p/b.html" and got["k2"].startswith("P/A__") and len({p.lower() for p in got.values()}) == 3


def test_rewrite(spark):
    html = (
        '<html><head><base href="/"><link rel="stylesheet" href="s.css" integrity="x"><meta http-equiv="refresh" content="3; url=two"></head><body><a href="two#f">2</a><a href="three" rel="nofollow">3</a><a href="#x">x</a>'
        '<img src="i.png" srcset="i.png 1x, j.png 2x"><style>p{background:url(i.png)}</style><iframe src="two"></iframe></body></html>'
    )
    pages = spark.createDataFrame([(1, "https://h.org/d/one", "pages/h.org/d/one/index.html", html)], "page_id bigint, url string, path string, html string")
    captured = spark.createDataFrame([("https://h.org/two", "pages/h.org/two/index.html")], "key string, path string")
    assets = spark.createDataFrame([("https://h.org/i.png", "assets/h.org/i.png"), ("https://h.org/s.css", "assets/h.org/s.css")], "key string, path string")
    row = rewrite.rewrite_pages(pages, captured, assets).first()
    up = "../../../../"
    for piece in (
        f'href="{up}assets/h.org/s.css"', 'href="../../two/index.html#f" data-offline="local"', 'href="https://h.org/three" rel="nofollow noopener" data-offline="remote" target="_blank"', '<a href="#x">x</a>',
        f'src="{up}assets/h.org/i.png"', f'srcset="{up}assets/h.org/i.png 1x, https://h.org/j.png 2x"', f'background:url("{up}assets/h.org/i.png")', 'content="3; url=../../two/index.html"', '<iframe src="../../two/index.html">', '<meta charset="utf-8">', rewrite.NAV_ID,
    ):
        assert piece in row.html, piece
    assert "<base" not in row.html and "integrity" not in row.html and (row.n_local, row.n_remote) == (1, 1)
    again = rewrite.rewrite_pages(pages.withColumn("html", F.lit(row.html)), captured, assets).first()
    assert again.html.count(rewrite.NAV_ID) == 1


def test_walls(spark):
    df = spark.createDataFrame([("<p>are you a robot</p>", None, None), (None, None, None), ("<p>hi</p>", "x", 200)], "html string, title string, status int")
    got = [walls.describe(walls.detect(F.col("html"), F.col("title"), F.col("status")))]
    assert [r[0] for r in df.select(*got).collect()] == ["unknown interstitial (wall wording)", None, None]


def test_multiplier_equals_a_plain_fold(spark):
    log = [("h", k, k % 3 == 0) for k in range(200)] + [("g", k, k < 3) for k in range(4)]
    df = spark.createDataFrame(log, "host string, k int, bad boolean")
    got = {r.host: r.multiplier for r in state.throttle_multiplier(df, ["k"]).collect()}
    for host in ("h", "g"):
        m = 1.0
        for h, _, bad in log:
            if h == host:
                m = min(32.0, m * 2) if bad else max(1.0, m / 1.15)
        assert abs(got[host] - m) < 1e-9


def test_report(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 << 20,), (1 << 50,)], "n bigint").select(H.human_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 MB", "1.0 PB"]
    crawled = spark.createDataFrame([("http://h/a", "t<i>", 200, 0, "pages/a.html", None), ("http://h/b", None, None, 1, "", "boom")], "url string, title string, status int, depth int, path string, error string")
    assets = spark.createDataFrame([(10, None)], "size bigint, error string")
    pending = spark.createDataFrame([("http://h/c", 2)], "key string, depth int")
    page = "".join(r.line for r in report.site_map(crawled, assets, pending, "h").orderBy("place").collect())
    assert page.startswith("<!doctype html>") and page.endswith("</html>")
    assert "t&lt;i&gt;" in page and "boom" in page and "http://h/c" in page and "10 B" in page


def test_rewrite_without_head_and_body(spark):
    """The charset comes first in the head, or where that would be; the link to the site map ends a page without a body's end."""
    htmls = ["<!DOCTYPE html><p>x", "<html><head><title>t</title><body>x</html>", '<html><head><meta charset="latin1"></head><body>x</body></html>', "x"]
    pages = spark.createDataFrame([(k, "https://h/a", "pages/h/a/index.html", h) for k, h in enumerate(htmls)], "page_id bigint, url string, path string, html string")
    none = spark.createDataFrame([], "key string, path string")
    got = [r.html for r in rewrite.rewrite_pages(pages, none).orderBy("page_id").collect()]
    assert got[0].startswith('<!DOCTYPE html><meta charset="utf-8"><p>x<div') and got[1].startswith('<html><head><meta charset="utf-8"><title>') and got[1].endswith("</div></html>")
    assert got[2].startswith('<html><head><meta charset="utf-8"></head>') and got[2].endswith("</div></body></html>") and got[3].startswith('<meta charset="utf-8">x<div')
    assert all(h.count(rewrite.NAV_ID) == h.count("charset") == 1 for h in got)


def test_mirror(spark):
    """A small site: a robots rule takes nothing of the budget, walls and files are no pages, what is missing is recorded."""
    from webloom.operators import mirror

    link = lambda *xs: "".join(f'<a href="/{x}">{x}</a>' for x in xs)
    rows = [("", link("a", "no", "wall", "pdf"), 200, None, None), ("a", link("b", "c", "gone"), 200, None, None), ("no", link("z"), 200, None, None), ("wall", "<p>are you a robot</p>", 200, None, None), ("pdf", "x", 200, "application/pdf", None), ("b", link("d"), 200, None, None), ("c", "", None, None, "timeout")]
    fetched = spark.createDataFrame([(f"https://h/{k}", f"https://h/{k}", h, "t", s, c, e) for k, h, s, c, e in rows], "key string, url string, html string, title string, status int, content_type string, error string")
    rules = spark.createDataFrame([("https://h", 0, False, "/no")], "origin string, seq int, allow boolean, prefix string")
    seeds = spark.createDataFrame([("https://h/", 0)], "key string, seq bigint")
    done = mirror.crawl(fetched, seeds, Scope(max_depth=2, max_pages=6), rules)
    got = {r.key.removeprefix("https://h/"): (r.depth, r.error) for r in done.records.collect()}
    assert got == {"": (0, None), "a": (1, None), "no": (1, "blocked by robots.txt"), "wall": (1, "challenge: unknown interstitial (wall wording)"), "b": (2, None), "c": (2, "timeout")}
    assert {r.key for r in done.files.collect()} == {"https://h/pdf"} and {r.key: r.depth for r in done.pending.collect()} == {"https://h/gone": 2, "https://h/d": 3}
    one = mirror.summary(done, fetched, multipliers=spark.createDataFrame([("h", 4.0), ("k", 1.0)], "host string, multiplier double")).first()
    assert (one.pages, one.failed, one.blocked, one.walled, one.walls_hit, one.assets, one.not_crawled, one.max_depth) == (3, 2, 1, 1, 1, 1, 2, 2)
    assert [(t.host, t.multiplier) for t in one.throttled] == [("h", 4.0)] and [f.error for f in one.failures] == ["timeout", "challenge: unknown interstitial (wall wording)"]
    pages, counts = mirror.finalize(done, fetched.where("key <> 'https://h/b'"))
    assert tuple(counts.first()) == (2, 1)
    html = {r.key: r.html for r in pages.collect()}
    assert 'href="a/index.html" data-offline="local"' in html["https://h/"] and 'href="https://h/no"' in html["https://h/"] and 'href="../b/index.html"' in html["https://h/a"]


def test_bodies(spark, tmp_path):
    import gzip

    from webloom.sources import feeds

    for name, raw in (("a", b"plain \xff"), ("b", gzip.compress(b"packed")), ("c", gzip.compress(b"broken")[:-9])):
        (tmp_path / name).write_bytes(raw)
    assert {r.name[-1]: r.body for r in feeds.bodies(spark, str(tmp_path)).collect()} == {"a": "plain \ufffd", "b": "packed", "c": ""}
    rows = spark.createDataFrame([("Sitemap: https://h/a.xml\nsitemap:https://h/b.xml",)], "body string")
    assert rows.select(feeds.robots_sitemaps(F.col("body"))).first()[0] == ["https://h/a.xml", "https://h/b.xml"]
    (tmp_path / "jar.json").write_text('[{"name": "a", "value": "1", "secure": true, "other": 2}, {"name": "b"}]')
    assert [(r.name, r.value, r.secure) for r in feeds.read_cookies(spark, f"{tmp_path}/jar.json").collect()] == [("a", "1", True)]
