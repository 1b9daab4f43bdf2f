"""Files of a mirror, settings from options, sessions and the console's lines."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import options
from webloom.operators import report, state
from webloom.sources import site_files


def test_files(spark, tmp_path):
    """Files come back as they were; nulls write nothing, a second write replaces, a path outside fails."""
    root = f"{tmp_path}/a b"
    rows = [("pages/h/a+b%20c.html", "<p>é</p>"), ("assets/x y.css", "a{}"), ("none", None), (None, "x"), ("empty.txt", "")]
    site_files.store(spark.createDataFrame(rows, "path string, content string").withColumn("more", F.lit(1)), root)
    site_files.store(spark.createDataFrame([("assets/x y.css", bytearray(b"\xff\0"))], "path string, content binary"), root)
    got = {r.path: bytes(r.content) for r in site_files.load(spark, root).collect()}
    assert got == {"pages/h/a+b%20c.html": "<p>é</p>".encode(), "assets/x y.css": b"\xff\0"}
    assert (tmp_path / "a b/empty.txt").read_bytes() == b""
    assert [p.name for p in tmp_path.rglob("*.part")] == []
    for bad in ("../x", "/x", "a/../../x", ""):
        with pytest.raises(Exception, match="not a path below the root"):
            site_files.store(spark.createDataFrame([(bad, "x")], "path string, content string"), root)
    site_files.store(spark.createDataFrame([], "path string, content string"), root)
    assert {r.path for r in site_files.load(spark, root, "assets").collect()} == {"assets/x y.css"}


def test_snapshots(spark, tmp_path):
    fetched = spark.createDataFrame([("https://h/a", "A"), ("https://h/b", None), ("https://h/c", "C")], "key string, html string")
    site_files.store_snapshots(fetched, str(tmp_path))
    records = fetched.select("key", F.when(F.col("key") != "https://h/c", site_files.raw_path(F.col("key"))).otherwise("").alias("raw"))
    assert [tuple(r) for r in site_files.snapshots(records, str(tmp_path)).collect()] == [("https://h/a", "A")]
    pages, manifest = spark.createDataFrame([("pages/h/a.html", "A2")], "path string, html string"), spark.createDataFrame([('{"version":1}',)], "value string")
    site_files.store_mirror(str(tmp_path), pages, manifest=manifest)
    site_files.discard_snapshots(spark, str(tmp_path))
    assert {r.path for r in site_files.load(spark, str(tmp_path)).collect()} == {"pages/h/a.html"}
    assert {r.path for r in site_files.load(spark, str(tmp_path), "_crawl").collect()} == {site_files.MANIFEST_FILE}


def test_options(spark):
    run = options.parse(spark, ["HTTPS://Shop.Example.com:443/a?b=1#c"])
    assert (run.start_url, run.output, run.scope.start_host, run.scope.max_depth, run.scope.max_pages, run.fetcher["workers"]) == ("https://shop.example.com/a?b=1", "output/shop.example.com", "shop.example.com", 3, 300, 4)
    assert run.assets and run.robots and run.sitemap and run.nav and run.keep_raw and run.scope.crawl_iframes and not run.resume
    line = "https://h.org/ -d -2 -n 5 --retries -1 --backoff -3 -w 0 --domain .CDN.org --include a+ --include b --ignore-query --no-iframes --no-assets --ignore-robots --no-nav --clean-raw --rewrite-only --manual-login"
    run = options.parse(spark, line.split())
    s = run.scope
    assert (s.max_depth, s.max_pages, s.max_retries, s.backoff, s.keep_query, s.crawl_iframes, s.include) == (0, 5, 0, 0.0, False, False, ("a+", "b")) and s.allowed_hosts == {"h.org", "cdn.org"}
    assert (run.assets, run.robots, run.nav, run.keep_raw, run.resume, run.sitemap) == (False, False, False, False, True, False) and run.fetcher["workers"] == 1 and run.fetcher["headless"] is False
    for bad in (["ftp://h/"], ["https://h/", "--exclude", "("]):
        with pytest.raises(ValueError, match="not a"):
            options.parse(spark, bad)


@pytest.mark.parametrize("seed", range(2))
def test_adopted_sessions(spark, seed):
    """Against a plain walk, with ties in time, more pieces than sites, walls without cookies and sites without walls."""
    import random

    r = random.Random(seed)
    rows = [(r.choice("aaab"), r.randrange(20), k, r.random() < 0.2, r.choice([None, f"s{k}"])) for k in range(300)] + [("c", 1, 900, False, None)]
    df = spark.createDataFrame(rows, "site string, at int, seq int, wall boolean, session string")
    got = {x.seq: (x.epoch, x.session) for x in state.adopted_sessions(df.where("NOT wall").drop("session"), df.where("wall")).collect()}
    want, now = {}, {}
    for site, _, seq, wall, left in sorted(rows, key=lambda x: x[:3]):
        epoch, had = now.get(site, (0, None))
        if wall:
            now[site] = (epoch + 1, left or had)
        else:
            want[seq] = (epoch, had)
    assert got == want


def test_report_lines(spark):
    one = spark.sql("SELECT 2L pages, 3L assets, 1572864L asset_bytes, 1 max_depth, 1L blocked, 0L walled, 0L cleared, array(named_struct('multiplier', 4.0D, 'host', 'h')) throttled, 1L failed, array(named_struct('url', 'u', 'error', 'e')) failures, 0L not_crawled")
    assert [r.line for r in report.console(one, 2.6).orderBy("pos").collect()] == ["pages: 2", "assets: 3, 1.5 MB", "greatest depth: 1", "left out by robots: 1", "slowed down: h x4", "failed: 1", "  u: e", "seconds: 3"]
    crawled = spark.createDataFrame([("k", "pages/h/index.html"), ("l", "")], "key string, path string")
    starts = spark.createDataFrame([("a", "k"), ("b", "l"), ("c", "m")], "site string, start_key string")
    assert {r.site: r.href for r in report.start_page(crawled, starts).collect()} == {"a": "pages/h/index.html", "b": "", "c": ""}


def test_cookie_files(spark, tmp_path):
    """A list, one cookie a line, one cookie over many lines; what is none gives nothing."""
    from webloom.sources import feeds

    files = {"list": '[{"name": "a", "value": "1"}, {"name": "b", "value": "2", "expiry": 5}, 7]', "lines": '{"name": "c", "value": "3"}\n\n{"name": "d", "value": "4", "secure": true}\r\nnone\n{"value": "5"}', "one": '{\n "name": "e",\n "value": "6"\n}', "none": "hello", "empty": ""}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.name: (r.value, r.secure, r.expiry) for r in feeds.read_cookies(spark, str(tmp_path)).collect()}
    assert got == {"a": ("1", None, None), "b": ("2", None, 5), "c": ("3", None, None), "d": ("4", True, None), "e": ("6", None, None)}


def test_manifests_that_are_cut_off(spark, tmp_path):
    from webloom.sources import feeds

    whole = '{"version": 1, "start_url": "u", "pages": {"k": {"url": "u", "depth": 0}}, "not_crawled": {}}'
    for name, text in (("whole", whole), ("cut", whole[:60]), ("other", "[1]"), ("text", "x"), ("empty", "")):
        (tmp_path / f"{name}.json").write_text(text)
    rows = feeds.read_manifest(spark, str(tmp_path))
    assert [(r.version, r.start_url) for r in rows.collect()] == [(1, "u")] and rows.count() == 1
    assert [r.key for r in feeds.manifest_pages(rows).collect()] == ["k"]
    assert feeds.read_manifest(spark, f"{tmp_path}/cut.json").isEmpty()


def test_sitemaps_are_read_once(spark):
    """Children behind the maps that a site names itself; a map that is named again, by the site or by an index, counts where it comes first."""
    from webloom.sources import feeds

    urls = lambda *xs: "<urlset>" + "".join(f"<loc>{x}</loc>" for x in xs) + "</urlset>"
    index = lambda *xs: "<sitemapindex>" + "".join(f"<loc>{x}</loc>" for x in xs) + "</sitemapindex>"
    rows = [("s", 0, "i", index("k1", "p", "k2", "k1", "i")), ("s", 1, "p", urls("a", "b")), ("s", 2, "p", urls("a", "b")), ("s", 3, "i", index("k2")), ("s", None, "k1", urls("c")), ("s", None, "k2", urls("d", "a")), ("t", 0, "n", None)]
    maps = spark.createDataFrame(rows, "site string, seq int, url string, body string")
    got = [tuple(r) for r in feeds.sitemap_urls(maps).orderBy("site", "pos").collect()]
    assert got == [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c"), ("s", 3, "d"), ("s", 4, "a")]
    assert [r.url for r in feeds.sitemap_urls(maps, 3).orderBy("pos").collect()] == ["a", "b", "c"]


def test_one_file_of_many_lines(spark, tmp_path):
    lines = spark.range(5000).select(F.format_string("%05d", (F.col("id") * 7919) % 5000).alias("place")).withColumn("line", F.concat(F.lit("é"), "place")).repartition(7)
    site_files.store_lines(lines, f"{tmp_path}/m")
    assert (tmp_path / "m/index.html").read_text() == "".join(f"é{k:05d}\n" for k in range(5000))
    site_files.store_lines(lines.limit(0), f"{tmp_path}/m")
    assert (tmp_path / "m/index.html").read_text() == "" and [p.name for p in (tmp_path / "m").iterdir() if p.name.endswith(".part")] == []
    crawled = spark.createDataFrame([("http://h/a", "t", 200, 0, "pages/a.html", None)], "url string, title string, status int, depth int, path string, error string")
    page = report.site_map(crawled, spark.createDataFrame([(10, None)], "size bigint, error string"), spark.createDataFrame([("http://h/c", 2)], "key string, depth int"), "h")
    site_files.store_mirror(f"{tmp_path}/n", spark.createDataFrame([], "path string, html string"), site_map=page)
    assert (tmp_path / "n/index.html").read_text() == "".join(r.line + "\n" for r in page.orderBy("place").collect())
