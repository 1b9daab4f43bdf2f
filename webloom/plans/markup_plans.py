"""Markup that is planted into every page: hidden links, all that is rewritten, assets that pages share, styles that lead on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import url as U
from webloom.operators import assets as A, links as L, rewrite
from webloom.plans.base import SQL_LINKS, pages, query, sql_canonical, sql_page_like

_I = "{i}"


def _text(template: str, **more: Column) -> Column:
    """``template`` with the page's number, and other columns, put in."""
    out = F.lit(template)
    for name, value in ({"i": F.col("page_id").cast("string")} | more).items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _sql_text(template: str, **more: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in ({"i": "CAST(page_id AS VARCHAR)"} | more).items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


_HIDDEN = (
    "<textarea><a href='/no1'></textarea><title><a href=/no2></title ><noscript><a href='/no3'></a></noscript><!-- <a href='/no4'> --><!--><xmp><a href=/no5></xmp>"
    "<script>'<a href=/no6>'</script><iframe src='/frame{i}'><a href=/no7></iframe></p title='<a href=/no8>'><a title='<a href=/no9>' HREF=/shown{i} href='/no10'>x</a><a href='/cut{i}"
)


@query(
    "WITH " + SQL_LINKS + f""", made AS (SELECT page_id, url, raw FROM links UNION ALL SELECT page_id, url, {_sql_text("/shown{i}")} FROM pages UNION ALL SELECT page_id, url, {_sql_text("/frame{i}")} FROM pages),
{sql_canonical("c", "made", "raw", "url")} SELECT DISTINCT page_id, key FROM c WHERE key IS NOT NULL AND {sql_page_like("fetch_url")}"""
)
def hidden_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages with look-alikes in bodies that are no markup, in comments, in values and in a tag that the page's end cuts off."""
    rows = pages(spark, sf_dir).select("page_id", "url", F.concat("html", _text(_HIDDEN)).alias("html"))
    return L.page_links(rows).select("page_id", "key")


_MARK = '<b id="mark"></b>'
_PLANTED = (
    _MARK + '<a href="/shown{i}#f">x</a><textarea><a href="/shown{i}"></textarea><img src="/i{i}.png" srcset="/i{i}.png 1x, /j{i}.png 2x"><iframe src=/shown{i}></iframe><style>@import "/s{i}.css"; p{background:url(/i{i}.png)}</style>'
    "<p style=\"background:url('/j{i}.png')\">y</p><LINK rel=stylesheet href=/s{i}.css integrity=x crossorigin><link rel=canonical href=/c{i}><meta http-equiv=Refresh content='5; URL=/gone{i}'><form action=/shown{i} action=/no>z</form><br/>"
)
_REWRITTEN = (
    _MARK + '<a href="{page}#f" {mark}>x</a><textarea><a href="/shown{i}"></textarea><img src="../../assets/i{i}.png" srcset="../../assets/i{i}.png 1x, {origin}/j{i}.png 2x"><iframe src="{page}"></iframe>'
    '<style>@import url("{origin}/s{i}.css"); p{background:url("../../assets/i{i}.png")}</style><p style="background:url(&quot;{origin}/j{i}.png&quot;)">y</p><LINK rel="stylesheet" href="{origin}/s{i}.css">'
    '<link rel="canonical" href="{origin}/c{i}"><meta http-equiv="Refresh" content="5; url={origin}/gone{i}"><form action="{page}" data-offline="{kind}">z</form><br/>'
)
_KNOWN = f"src AS (SELECT page_id, url AS raw, NULL AS base FROM pages), {sql_canonical('page', 'src')}, o AS (SELECT page_id, page_id % 2 = 0 AS here, regexp_extract(fetch_url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM page WHERE key IS NOT NULL)"


@query(
    f"WITH {_KNOWN} SELECT page_id, "
    + _sql_text(
        _REWRITTEN, page=f"CASE WHEN here THEN {_sql_text('../shown{i}.html')} ELSE origin || {_sql_text('/shown{i}')} END", kind="CASE WHEN here THEN 'local' ELSE 'remote' END",
        mark="""CASE WHEN here THEN 'data-offline="local"' ELSE 'data-offline="remote" target="_blank" rel="noopener"' END""", origin="origin",
    )
    + " AS html FROM o"
)
def rewritten_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of links, images, frames, styles, sheets, refreshes and forms that are planted at the end of every page."""
    rows = pages(spark, sf_dir).select("page_id", U.canonical(F.col("url"))["fetch_url"].alias("url"), F.concat("html", _text(_PLANTED)).alias("html")).where("url IS NOT NULL")
    origin = F.rtrim(U.origin(F.col("url")), F.lit("/"))
    there = lambda name: F.concat(origin, _text(f"/{name}"))
    captured = rows.where("page_id % 2 = 0").select(there("shown{i}").alias("key"), _text("pages/shown{i}.html").alias("path")).dropDuplicates(["key"])
    assets = rows.select(there("i{i}.png").alias("key"), _text("assets/i{i}.png").alias("path")).dropDuplicates(["key"])
    out = rewrite.rewrite_pages(rows.withColumn("path", _text("pages/p{i}/index.html")), captured, assets, nav=False)
    return out.select("page_id", F.substring("html", F.locate(_MARK, F.col("html")), F.length("html")).alias("html"))


_ASSETS = "<img src='https://cdn.example/{a}.png'><p>x</p><img src='https://cdn.example/{a}.png' srcset='https://cdn.example/{a}.png 1x, /own{i}.png 2x'><object data=https://cdn.example/o{b}.bin></object><link rel=icon href=https://cdn.example/logo.ico><img src='data:x'>"
_ASSET_ROWS = (
    f"WITH {_KNOWN}, r AS (SELECT page_id, unnest([{{'pos': 0, 'key': {{a}}}}, {{'pos': 1, 'key': {{a}}}}, {{'pos': 2, 'key': {{b}}}}, {{'pos': 3, 'key': {{a}}}}, {{'pos': 4, 'key': {{o}}}}, {{'pos': 5, 'key': 'https://cdn.example/logo.ico'}}, {{'pos': 6, 'key': {{b}}}}], recursive := true) FROM o)"
    .replace("{a}", "'https://cdn.example/' || CAST(page_id % 10 AS VARCHAR) || '.png'").replace("{b}", "'https://cdn.example/o' || CAST(page_id % 3 AS VARCHAR) || '.bin'").replace("{o}", "origin || '/own' || CAST(page_id AS VARCHAR) || '.png'")
)


def _asset_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = _text(_ASSETS, a=(F.col("page_id") % 10).cast("string"), b=(F.col("page_id") % 3).cast("string"))
    rows = pages(spark, sf_dir).select("page_id", U.canonical(F.col("url"))["fetch_url"].alias("url"), F.concat("html", planted).alias("html")).where("url IS NOT NULL")
    return A.page_asset_refs(rows)


@query(_ASSET_ROWS + " SELECT key, arg_min(page_id, page_id * 10 + pos) AS page_id, count(*) AS n_refs FROM r GROUP BY key")
def asset_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every asset that pages share the page that fetches it, and how many references wait for it."""
    return A.claims(_asset_refs(spark, sf_dir), ["page_id"]).select("key", "page_id", "n_refs")


@query(_ASSET_ROWS + " SELECT page_id, count(*) AS n_refs, count(*) FILTER (sha1(key) >= '4') AS n_ok FROM r GROUP BY page_id")
def assets_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page its references to assets and those that were stored; a quarter of the assets fail, by their hash."""
    refs = _asset_refs(spark, sf_dir)
    outcomes = refs.select("key").distinct().select("key", F.when(F.sha1("key") < "4", "HTTP 404").alias("error"))
    return A.page_successes(refs, outcomes)


_CSS = "https://css.example/"
_STYLED = f"<link rel=stylesheet href={_CSS}{{a}}.css><style>@import '{_CSS}{{b}}.css'; p{{background:url({_CSS}{{a}}.png)}}</style><p style='background:url({_CSS}x{{i}}.png)'>"


@query(
    f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), e AS (SELECT '{_CSS}' || page_id || '.css' AS src, unnest(['{_CSS}' || ((2 * page_id + 1) % n) || '.css', '{_CSS}' || (page_id // 2) || '.css', '{_CSS}' || page_id || '.png']) AS dst FROM pages, n),
s AS (SELECT page_id, unnest([{{'key': '{_CSS}' || (page_id % 7) || '.css', 'depth': 0}}, {{'key': '{_CSS}' || ((5 * page_id + 2) % n) || '.css', 'depth': 1}}, {{'key': '{_CSS}' || (page_id % 7) || '.png', 'depth': 1}}, {{'key': '{_CSS}x' || page_id || '.png', 'depth': 1}}], recursive := true) FROM pages, n),
b AS (SELECT page_id, key, depth FROM s UNION SELECT b.page_id, e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.key WHERE b.depth < 4) SELECT page_id, key, CAST(min(depth) AS INT) AS depth FROM b GROUP BY page_id, key"""
)
def page_style_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's links and inline styles lead to within four steps; a sheet for every page, two imports in each, with circles."""
    rows = pages(spark, sf_dir)
    one = rows.agg(F.count("*").alias("n"))
    numbered = rows.crossJoin(F.broadcast(one))  # one row
    name = lambda n: F.concat(n.cast("string"), F.lit(".css"))
    i, n = F.col("page_id"), F.col("n")
    sheets = numbered.select(
        F.concat(F.lit(_CSS), name(i)).alias("key"), F.concat(F.lit(_CSS), name(i)).alias("url"),
        F.concat(F.lit("@import '"), name((2 * i + 1) % n), F.lit("'; @import url("), name(F.expr("page_id div 2")), F.lit("); p{background:url("), i.cast("string"), F.lit(".png)}")).alias("css"),
    )
    styled = numbered.select("page_id", "url", F.concat("html", _text(_STYLED, a=(i % 7).cast("string"), b=((5 * i + 2) % n).cast("string"))).alias("html"))
    return A.page_sheets(styled, sheets)
