"""Tokens of html: bodies that are no markup, equal attributes, broken tags, and time that follows the length."""

import html.parser
import random
import time

import pytest
from pyspark.sql import functions as F

from webloom.functions import html as H, markup
from webloom.operators import links as L, rewrite

SCHEMA = "page_id bigint, url string, path string, html string"


class Reader(html.parser.HTMLParser):
    """Start tags by the standard parser, which knows scripts and styles; the other bodies are left out here."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.tags, self.inside = [], None

    def handle_starttag(self, tag, attrs):
        if self.inside is None:
            first = {}
            for k, v in attrs:
                first.setdefault(k, v or "")
            self.tags.append((tag, first.get("href")))
            if tag in markup.RAW and tag not in ("script", "style"):
                self.inside = tag

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag == self.inside:
            self.inside = None


def standard(text):
    reader = Reader()
    reader.feed(text)
    reader.close()
    return reader.tags


def tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, html string")
    read = F.transform(H.tags(F.col("html")), lambda t: F.struct(H.tag_name(t).alias("n"), F.coalesce(H.attr(t, "href"), F.when(H.has_attr(t, "href"), "")).alias("h")))
    return [[(x.n, x.h) for x in r.t] for r in df.select("i", read.alias("t")).orderBy("i").collect()]


CASES = [
    '<a href="/1">x</a><textarea><a href="/no"></textarea><a href="/2">', "<title><a href=/no></title><a href='/1'>", '<noscript><a href="/no"></noscript ><a href="/1">', "<!-- <a href=/no> --><a href=/1>", 
    '<a href="/1" href="/2">', "<A HREF=/1 Href=/2>", "<a title='<a href=\"/no\">' href=/1>", "<a href='/a>b'>", "<script>'<a href=/no>'</script><a href=/1>", "<STYLE>x{}</STYLE><iframe src=/f><a href=/no></iframe><a href=/1>", "<p/><br /><a/href=/1>",
    "</p title='<a href=/no>'><a href=/1>", "<a href=/1>x<b", "<xmp><a href=/no></xmp><a href=/2>", "a < b <a href=/1> c > d", "<scripty><a href=/1>", "<title>x</titles><a href=/no></title><a href=/1>", "",
]


def test_cases(spark):
    assert tokens(spark, CASES) == [standard(c) for c in CASES]
    # The html standard's own ends of comments, and tags that the page's end cuts off.
    assert tokens(spark, ["<!--><a href=/1>-->", "<!-- x --!><a href=/1>", "<a href='/no>", "<a href=/no "]) == [[("a", "/1")], [("a", "/1")], [], []]


@pytest.mark.parametrize("seed", range(3))
def test_generated_pages(spark, seed):
    """Against the standard parser, on pages put together from whole pieces."""
    r = random.Random(seed)
    pieces = [c for c in CASES if c != "<a href=/1>x<b"] + ["text ", "<p>", "</p>", "<b class='q w'>", "&amp;", "\n"]
    texts = ["".join(r.choices(pieces, k=r.randrange(1, 30))) for _ in range(60)]
    assert tokens(spark, texts) == [standard(t) for t in texts]


def test_columns_and_rewriter_agree(spark):
    """What is counted as a link is what the rewriter changes, and nothing else."""
    texts = [f"<html><head></head><body>{c}</body></html>" for c in CASES]
    pages = spark.createDataFrame([(k, "https://h/p", "pages/h/p.html", t) for k, t in enumerate(texts)], SCHEMA)
    captured = spark.createDataFrame([(f"https://h/{k}", f"pages/h/{k}.html") for k in ("1", "2", "no")], "key string, path string")
    rows = {r.page_id: r for r in rewrite.rewrite_pages(pages, captured, nav=False).collect()}
    found = {}
    for r in L.page_links(pages).collect():
        found.setdefault(r.page_id, set()).add(r.key)
    for k in range(len(CASES)):
        assert "https://h/no" not in found.get(k, ()), CASES[k]
        assert 'data-offline="local"' not in rows[k].html or found.get(k), CASES[k]
        assert "no.html" not in rows[k].html, CASES[k]
    assert rows[5].html.count("data-offline") == 1 and 'href="1.html"' in rows[5].html


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a b="', "<!--", "<script>", "<style>", "<title>", "</a ", "<!", "<a b=", "<", "<textarea><", "<a href='x' "])
def test_broken_markup_takes_linear_time(spark, piece):
    text = piece * (400_000 // len(piece))
    began = time.time()
    page = rewrite._Page({}, "index.html", "https://h/", True).rewrite(text)
    assert text.startswith("<") and len(page) >= len(text) * 0.9 and time.time() - began < 5
    pages = spark.createDataFrame([(1, "https://h/p", "pages/h/p.html", text)], SCHEMA)
    began = time.time()
    assert L.page_links(pages).count() <= 1
    pages.select(F.size(H.bodies(F.col("html"), "style")), H.title(F.col("html"))).collect()
    assert time.time() - began < 20
