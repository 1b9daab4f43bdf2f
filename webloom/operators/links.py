"""Links and assets of pages, without an exchange: each page's are worked out within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import fixed, html as H, url as U
from webloom.functions.scope import Scope


def _values(tags: Column, pairs: list[tuple[str, str]]) -> Column:
    """Trimmed attribute values, by pair and then document order, without blank ones; every tag is looked at once."""
    attrs = {attr: [name for name, a in pairs if a == attr] for _, attr in pairs}

    def read(t: Column) -> Column:
        one = lambda n: F.struct(n.alias("n"), *[F.when(n.isin(names), H.attr_raw(t, attr)).alias(f"a{k}") for k, (attr, names) in enumerate(attrs.items())])
        return U.let(H.tag_name(t), one)

    def of(seen: Column, name: str, field: str) -> Column:
        return F.transform(F.filter(seen, lambda x: x["n"] == name), lambda x: x[field])

    field = {attr: f"a{k}" for k, attr in enumerate(attrs)}
    by_pair = lambda seen: F.concat(*[of(seen, name, field[attr]) for name, attr in pairs])
    raws = U.let(F.transform(tags, read), by_pair)
    return F.filter(F.transform(F.filter(raws, lambda r: r != ""), lambda r: U.strip(H.attr_value(r))), lambda v: v != "")


def _refreshes(tags: Column) -> Column:
    metas = F.filter(tags, lambda t: (H.tag_name(t) == "meta") & F.coalesce(H.attr(t, "http-equiv"), F.lit("")).rlike("(?i)refresh"))
    return F.filter(F.transform(metas, lambda t: H.meta_refresh(F.coalesce(H.attr(t, "content"), F.lit("")))), lambda v: v.isNotNull())


def page_refs(tags: Column, scope: Scope) -> Column:
    """Raw page references of tags: links, areas, forms, then frames, then refreshes."""
    return F.concat(_values(tags, fixed.PAGE_ATTRS + (fixed.FRAME_ATTRS if scope.crawl_iframes else [])), _refreshes(tags))


def candidates(html: Column, scope: Scope) -> Column:
    """Raw page references of a page, from the tags that can hold any."""
    names = sorted({name for name, _ in fixed.PAGE_ATTRS + fixed.FRAME_ATTRS} | {"meta"})
    return U.let(H.tags(html, names), lambda t: page_refs(t, scope))


def page_keys(html: Column, page_url: Column, scope: Scope) -> Column:
    """Keys of the pages that a page links to, first mention first, each once."""
    raws = candidates(html, scope)
    found = U.let(H.base_url(html, page_url), lambda b: F.transform(raws, lambda r: U.canonical(r, b, scope.keep_query)))
    wanted = lambda c: c.isNotNull() & U.looks_like_page(c["fetch_url"]) & (U.in_scope(c["fetch_url"], scope) if scope.start_host or scope.allowed_hosts or scope.exclude or scope.include else F.lit(True))
    return F.array_distinct(F.transform(F.filter(found, wanted), lambda c: c["key"]))


def page_links(pages: DataFrame, scope: Scope | None = None) -> DataFrame:
    """(page_id, pos, key): the pages that each page links to. A scope without hosts takes every host."""
    scope = scope or Scope()
    keys = page_keys(F.coalesce(F.col("html"), F.lit("")), F.col("url"), scope)
    # The outer form: for the other one the optimizer adds a filter that works all keys out again.
    return pages.select("page_id", F.posexplode_outer(keys).alias("pos", "key")).where("key IS NOT NULL")


def all_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, raw, fetch_url, key) of every link element, pos being its tag's number from 1."""
    tags = pages.select("page_id", "url", F.posexplode_outer(H.tags(F.col("html"))).alias("p", "tag")).where("tag IS NOT NULL")
    raw = tags.where(H.tag_name(F.col("tag")) == "a").select("page_id", "url", (F.col("p") + 1).alias("pos"), U.strip(H.attr(F.col("tag"), "href")).alias("raw")).where("raw <> ''")
    return raw.select("*", U.canonical(F.col("raw"), F.col("url")).alias("c")).select("page_id", "url", "pos", "raw", F.col("c.fetch_url").alias("fetch_url"), F.col("c.key").alias("key"))


def link_refs(tags: Column, kind: str | None = None) -> Column:
    """Targets of link elements, of one kind or of both."""
    links = F.filter(tags, lambda x: (H.tag_name(x) == "link") & H.attr(x, "href").isNotNull() & (F.lit(True) if kind is None else H.link_kind(x) == kind))
    return F.transform(links, lambda x: U.strip(H.attr(x, "href")))


def asset_refs_of(tags: Column) -> Column:
    """Raw asset references of tags: attributes, srcset entries, links to assets; those to inline data are left out."""
    sets = F.flatten(F.transform(_values(tags, fixed.SRCSET_ATTRS), lambda v: F.transform(H.srcset(v), lambda e: e["url"])))
    refs = F.concat(_values(tags, fixed.ASSET_ATTRS), sets, link_refs(tags, "asset"))
    return F.filter(refs, lambda v: (v != "") & ~v.rlike("^(data:|blob:|about:|#)"))


def asset_refs(html: Column) -> Column:
    names = sorted({name for name, _ in fixed.ASSET_ATTRS + fixed.SRCSET_ATTRS} | {"link"})
    return U.let(H.tags(html, names), asset_refs_of)


def style_texts(html: Column) -> Column:
    """Bodies of style elements."""
    return H.bodies(html, "style")


def css_refs_of(styles: Column, tags: Column) -> Column:
    """References in style texts and in the style attributes of tags."""
    attrs = F.transform(F.filter(tags, lambda t: t.rlike("(?i)style") & H.has_attr(t, "style")), lambda t: F.coalesce(H.attr(t, "style"), F.lit("")))
    both = F.filter(F.concat(styles, attrs), lambda c: c.rlike(r"(?i)url\(|@import"))
    refs = F.flatten(F.transform(both, lambda c: F.concat(H.css_imports(c), H.css_urls(c))))
    return F.filter(refs, lambda v: (v != "") & ~v.rlike("^(data:|about:|#)"))


def css_refs(html: Column) -> Column:
    return U.let(H.tags(html), lambda t: css_refs_of(style_texts(html), t))


def page_assets(pages: DataFrame) -> DataFrame:
    """(page_id, pos, fetch_url, key) of the assets that pages and their inline styles name, each once for a page."""
    refs = F.array_distinct(F.concat(asset_refs(F.col("html")), css_refs(F.col("html"))))
    canon = U.let(H.base_url(F.col("html"), F.col("url")), lambda b: F.filter(F.transform(refs, lambda r: U.canonical(r, b)), lambda c: c.isNotNull()))
    rows = pages.select("page_id", F.posexplode_outer(canon).alias("p", "c")).where("c IS NOT NULL").select("page_id", "p", F.col("c.fetch_url").alias("fetch_url"), F.col("c.key").alias("key"))
    return rows.groupBy("page_id", "key").agg(F.min("p").alias("pos"), F.min_by("fetch_url", "p").alias("fetch_url"))


def resolve_links(links: DataFrame, captured: DataFrame) -> DataFrame:
    """``links`` (key, fetch_url, ...) with ``offline`` (local, remote) and ``path`` of the captured page, if there is one.

    The join is on the key; a key that a third of all links share is split by adaptive execution.
    """
    return links.join(captured.select("key", "path"), "key", "left").withColumn("offline", F.when(F.col("path").isNotNull(), "local").when(F.col("fetch_url").isNotNull(), "remote"))


def first_seen(links: DataFrame, order: list[str]) -> DataFrame:
    """Of each key the first row by ``order``: an aggregate that combines before its shuffle."""
    rest = [c for c in links.columns if c != "key"]
    return links.groupBy("key").agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("r")).select("key", *[F.col(f"r.{c}").alias(c) for c in rest])


def allocate_paths(rows: DataFrame) -> DataFrame:
    """``rows`` (seq, key, path) with a path of its own for each key, told apart without case.

    The first of each path keeps it, the others get a hash of their key before the extension; paths that clash
    even then get a number. Rows are one for each key.
    """

    def clash(df: DataFrame) -> DataFrame:
        first = df.groupBy(F.lower("path").alias("low")).agg(F.min(F.struct("seq", "key")).alias("f"))
        return df.join(first, F.lower("path") == F.col("low")).withColumn("is_first", (F.col("f.seq") == F.col("seq")) & (F.col("f.key") == F.col("key"))).drop("low", "f")

    def marked(mark: Column) -> Column:
        ext = U.extension(F.col("path"))
        return F.concat(F.substring("path", F.lit(1), F.length("path") - F.length(ext)), F.lit("__"), mark, ext)

    once = clash(rows)
    renamed = once.withColumn("out", F.when(F.col("is_first"), F.col("path")).otherwise(marked(U.short_hash(F.col("key")))))
    # Keys that share path and hash: next to none, so the window's groups are single rows.
    again = Window.partitionBy(F.lower("out")).orderBy("seq", "key")
    n = F.row_number().over(again) - 1
    final = renamed.withColumn("n", n).withColumn("path", F.when(F.col("n") == 0, F.col("out")).otherwise(marked(F.concat(U.short_hash(F.col("key")), F.lit("_"), F.col("n").cast("string")))))
    return final.drop("is_first", "out", "n")
