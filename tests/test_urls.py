"""URL functions against the standard library and stated vectors."""

import posixpath
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import url as U
from webloom.functions.scope import Scope

VECTORS = {
    "HTTPS://H.com.:443/a//b/../c/?b=2&a=1": ("https://h.com/a/c/?b=2&a=1", "https://h.com/a/c?a=1&b=2"),
    "http://x.org/es/12?utm_source=feed": ("http://x.org/es/12", "http://x.org/es/12"),
    "http://u:p@h:8080/x": ("http://h:8080/x", "http://h:8080/x"),
    "http://h/100%25": ("http://h/100%", "http://h/100%"),
    "http://h/a?b&c=": ("http://h/a?b=&c=", "http://h/a?b=&c="),
}


def canonical(spark, rows):
    df = spark.createDataFrame(rows, "raw string, base string").select("raw", "base", U.canonical(F.col("raw"), F.col("base")).alias("c"))
    return [(r.raw, r.base, tuple(r.c) if r.c else None) for r in df.collect()]


def test_vectors(spark):
    got = {raw: c for raw, _, c in canonical(spark, [(k, None) for k in VECTORS])}
    assert got == VECTORS


def test_not_fetchable(spark):
    rows = [(r, "http://h/") for r in ("", "   ", "#a", "mailto:a@b", "JAVASCRIPT:1", "ftp://h/x", "data:,x", None)] + [("//h/x", None), ("http://", None), ("http://h:x/", None)]
    assert all(c is None for *_, c in canonical(spark, rows))


def expected(raw, base):
    parts = urlsplit(urljoin(base, raw))
    path = parts.path or "/"
    folded = posixpath.normpath(path)
    if path.endswith("/") and not folded.endswith("/"):
        folded += "/"
    folded = quote(unquote(folded), safe="/~:@!$&'()*+,;=%-._")
    return f"{parts.scheme}://{parts.hostname}{folded}" + (f"?{urlencode(parse_qsl(parts.query, keep_blank_values=True))}" if parse_qsl(parts.query, keep_blank_values=True) else "")


segment = st.text("abcxyz.~_-é %+!*'(),=&@", max_size=6).map(lambda s: s.replace("%", "%41"))
relative = st.lists(st.one_of(segment, st.sampled_from(["..", ".", ""])), min_size=1, max_size=5).map("/".join).filter(lambda s: ":" not in s and not s.startswith("//"))


@settings(max_examples=8, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(relative, st.text("abé=&+~*.", max_size=8)), min_size=40, max_size=40))
def test_against_the_standard_library(spark, rows):
    base = "http://h.org/p/q/r?z=1"
    raws = [p.strip() + (f"?{q}" if q else "") for p, q in rows]
    raws = [r for r in raws if r.strip() and not r.startswith("//")]
    got = canonical(spark, [(r, base) for r in raws])
    for raw, _, c in got:
        assert c and c[0] == expected(raw.strip(), base), raw


def test_scope(spark):
    scope = Scope(start_host="www.a.co.uk", include_subdomains=True, extra_domains=frozenset({"b.org"}), path_prefix="/docs", include=("x",), exclude=("secret",), max_depth=-1)
    assert scope.max_depth == 0 and scope.start_domain() == "a.co.uk"
    urls = ["http://m.a.co.uk/docs/x", "http://b.org/docs/x", "http://c.b.org/docs/x", "http://a.co.uk/docs/y", "http://a.co.uk/x", "http://other.uk/docs/x", "http://a.co.uk/docs/x/secret"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.in_scope(F.col("u"), scope).alias("ok"))
    assert [r.ok for r in df.collect()] == [True, True, True, False, False, False, False]


def test_pages_and_assets(spark):
    cases = {"/et.": False, "/the,": True, "/report.v2": False, "/x.longext": True, "/a.css": False, "/": True, "/.htaccess": True, "/a.PHP": True}
    df = spark.createDataFrame([(f"http://h{p}",) for p in cases], "u string").select(U.looks_like_page(F.col("u")).alias("ok"))
    assert [r.ok for r in df.collect()] == list(cases.values())
