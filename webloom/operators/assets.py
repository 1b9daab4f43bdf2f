"""Assets of many pages: who fetches each first, what each page got, and the style sheets that pages lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom import session
from webloom.functions import html as H, url as U
from webloom.functions.scope import Scope
from webloom.operators import links as L

#: Keys with more than this share of all references are at most as many as its inverse: their outcomes are broadcast.
HEAVY = 1024


def page_asset_refs(pages: DataFrame) -> DataFrame:
    """(page_id, pos, fetch_url, key) of every reference to an asset in ``pages`` (page_id, url, html), each as often as it is asked for.

    References in styles are no part of it. An object's data are asked for twice, once with the other attributes and once behind them.
    """
    html = F.coalesce("html", F.lit(""))
    objects = F.filter(L._values(H.tags(html, ["object"]), [("object", "data")]), lambda v: ~v.rlike("^(data:|blob:|about:|#)"))
    refs = F.concat(L.asset_refs(html), objects)
    canon = U.let(H.base_url(html, F.col("url")), lambda b: F.filter(F.transform(refs, lambda r: U.canonical(r, b)), lambda c: c.isNotNull()))
    rows = pages.select("page_id", F.posexplode_outer(canon).alias("pos", "c")).where("c IS NOT NULL")
    return rows.select("page_id", "pos", F.col("c.fetch_url").alias("fetch_url"), F.col("c.key").alias("key"))


def claims(refs: DataFrame, order: list[str]) -> DataFrame:
    """(key, fetch_url, page_id, n_refs): each asset with the reference that fetches it, the first by ``order``; the others wait for its outcome.

    An asset that every page names is an aggregate that combines before its shuffle.
    """
    first = refs.groupBy("key").agg(F.min(F.struct(*dict.fromkeys([*order, "pos", "page_id", "fetch_url"]))).alias("f"), F.count("*").alias("n_refs"))
    return first.select("key", F.col("f.fetch_url").alias("fetch_url"), F.col("f.page_id").alias("page_id"), "n_refs")


def page_successes(refs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(page_id, n_refs, n_ok): each page's references (page_id, key) and those whose asset was stored, by ``outcomes`` (key, error).

    Outcomes reach the pages by key. Assets that a large share of all references name are few, so their outcomes are broadcast; the
    others are joined. An asset without an outcome was not stored.
    """
    each = refs.groupBy("page_id", "key").agg(F.count("*").alias("n"))
    asked = session.materialise(each.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("pages")), "asked", tidy=False)
    bound = asked.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0] / HEAVY
    ok = outcomes.groupBy("key").agg(F.min(F.coalesce("error", F.lit("")) == "").alias("ok"))
    told = asked.join(ok, "key", "left").select("key", F.coalesce("ok", F.lit(False)).alias("ok"), F.col("pages") > bound)
    told = session.materialise(told.toDF("key", "ok", "heavy"), "told", tidy=False)
    heavy = F.broadcast(told.where("heavy").select("key", "ok"))  # fewer than HEAVY rows
    near = each.join(heavy, "key")
    rest = each.join(heavy.select("key"), "key", "left_anti").join(told.where("NOT heavy").select("key", "ok"), "key")
    return near.unionByName(rest).groupBy("page_id").agg(F.sum("n").alias("n_refs"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("n_ok"))


def _sheet_edges(sheets: DataFrame) -> DataFrame:
    css = F.coalesce("css", F.lit(""))
    named = sheets.select(F.col("key").alias("src"), "url", F.explode_outer(F.array_distinct(F.concat(H.css_imports(css), H.css_urls(css)))).alias("raw")).where("raw IS NOT NULL")
    return named.select("src", U.canonical(F.col("raw"), F.col("url"))["key"].alias("dst")).where("dst IS NOT NULL").distinct()


def _starts(html: Column, url: Column) -> Column:
    """What a page's own style names, with the depth at which it is fetched: linked assets at 0, those of its inline styles at 1."""
    at = lambda refs, depth: F.transform(refs, lambda r: F.struct(r.alias("raw"), F.lit(depth).alias("depth")))
    both = F.concat(at(_linked(html), 0), at(L.css_refs(html), 1))
    return U.let(H.base_url(html, url), lambda b: F.transform(both, lambda x: F.struct(U.canonical(x["raw"], b)["key"].alias("key"), x["depth"].alias("depth"))))


def _linked(html: Column) -> Column:
    return F.filter(L.link_refs(H.tags(html, ["link"]), "asset"), lambda v: v != "")


def page_sheets(pages: DataFrame, sheets: DataFrame, scope: Scope | None = None) -> DataFrame:
    """(page_id, key, depth): what each of ``pages`` (page_id, url, html) leads to through ``sheets`` (key, url, css), at its smallest depth.

    Links to assets come at depth 0, what inline styles name at depth 1; a sheet above ``css_depth`` leads on to what it imports and names,
    one deeper. The steps from sheet to sheet are worked out once for all pages that share a sheet; circles end at what was met.
    """
    most = (scope or Scope()).css_depth
    html = F.coalesce("html", F.lit(""))
    starts = pages.select("page_id", F.explode_outer(_starts(html, F.col("url"))).alias("s")).where("s.key IS NOT NULL")
    starts = session.materialise(starts.groupBy("page_id", F.col("s.key").alias("start")).agg(F.min("s.depth").alias("depth")), "starts", tidy=False)
    edges = session.materialise(_sheet_edges(sheets), "sheet-links", tidy=False)
    step = starts.select(F.col("start").alias("src"), F.col("start").alias("dst"), F.lit(0).alias("steps")).distinct()
    reach = step = session.materialise(step, "reach", tidy=False)
    for k in range(1, most + 1):
        further = step.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
        step = session.materialise(further.join(reach.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("steps", F.lit(k)), "reach", tidy=False)
        reach = reach.unionByName(step)
    all_ = starts.join(reach, F.col("start") == F.col("src")).select("page_id", F.col("dst").alias("key"), (F.col("depth") + F.col("steps")).alias("depth"))
    return all_.where(F.col("depth") <= most).groupBy("page_id", "key").agg(F.min("depth").alias("depth"))
