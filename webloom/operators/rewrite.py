"""Second pass: pages rewritten so that a mirror browses offline.

What every page's references resolve to is worked out by joins; each page then gets the map of its own references
and is rewritten in one pass over its text. Only that last, per-page step is Python, in Arrow batches.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import fixed, html as H, markup, url as U
from webloom.functions.scope import Scope
from webloom.operators import frontier, links as L

_TOKEN = re.compile(rf"{markup.COMMENT}|</(?P<end>{markup.NAME}){markup.ATTRS}(?:>|{markup.END})|<(?P<name>{markup.NAME})(?P<attrs>{markup.ATTRS})(?P<close>>|{markup.END})|{markup.OTHER}", re.A | re.I)
_ATTR = re.compile(rf"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:{markup.SPACE}*+={markup.SPACE}*+({markup.VALUE})?+)?+", re.A | re.I)
_DOCTYPE = re.compile(r"\s*<!doctype[^>]*>", re.I)
_CLOSES = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>]|{markup.END})", re.A | re.I) for name in markup.RAW}
#: An import or else a url(): one pass, so that what an import became isn't matched again.
_CSS = re.compile("(" + fixed.CSS_IMPORT.replace(r"\1", r"\2") + ")|" + fixed.CSS_URL.replace(r"\1", r"\4"), re.I)
_REFRESH = re.compile(fixed.META_REFRESH, re.I)
_INLINE = ("data:", "blob:", "about:", "#")
_NO_PAGE = ("#", "javascript:", "mailto:", "tel:", "sms:", "data:")
NAV_ID = "webloom-nav"
#: Characters of rewritten texts that a task holds before it hands them on.
HELD = 4 << 20
_PAGE, _ASSET, _SETS = set(fixed.PAGE_ATTRS), set(fixed.ASSET_ATTRS), set(fixed.SRCSET_ATTRS)


class _Page:
    """One page's rewriting; ``known`` maps raw references to (absolute URL, local page, local asset)."""

    def __init__(self, known: dict[str, tuple], home: str, live: str, nav: bool) -> None:
        self.known, self.home, self.live, self.nav = known, home, live, nav
        self.n_local = self.n_remote = 0

    def _look(self, raw: str) -> tuple:
        return self.known.get(raw.strip(), (None, None, None))

    def _asset(self, raw: str) -> str:
        if raw.strip().startswith(_INLINE):
            return raw
        absolute, _, asset = self._look(raw)
        return asset or absolute or raw

    def _css(self, text: str) -> str:
        def one(m: re.Match) -> str:
            target = m[3] if m[1] else m[5]
            if target.strip().startswith(_INLINE):
                return m[0]
            return ("@import " if m[1] else "") + f'url("{self._asset(target)}")'

        return _CSS.sub(one, text)

    def _link(self, tag: str, attrs: dict, name: str) -> None:
        value = attrs[name].strip()
        if not value or value.lower().startswith(_NO_PAGE):
            return
        target, mark, fragment = value.partition("#")
        absolute, page, _ = self._look(target)
        if page:
            attrs[name], attrs["data-offline"] = page + mark + fragment, "local"
            self.n_local += 1
        elif absolute:
            attrs[name], attrs["data-offline"] = absolute + mark + fragment, "remote"
            self.n_remote += 1
            if tag == "a":
                attrs["target"] = attrs.get("target") or "_blank"
                rels = (attrs.get("rel") or "").split()
                attrs["rel"] = " ".join(rels if "noopener" in rels else [*rels, "noopener"])

    def _kind(self, attrs: dict) -> str:
        rels = set((attrs.get("rel") or "").lower().split())
        if rels & set(fixed.ASSET_RELS):
            return "asset"
        if rels & set(fixed.ABSOLUTE_RELS):
            return "absolute"
        return "asset" if attrs.get("as") or attrs.get("type") else "absolute"

    def tag(self, tag: str, attrs: dict) -> None:
        for name in [n for n, v in attrs.items() if v is not None]:
            if (tag, name) in _PAGE:
                self._link(tag, attrs, name)
            elif (tag, name) in _ASSET:
                attrs[name] = self._asset(attrs[name])
            elif (tag, name) in _SETS:
                entries = [c.split(None, 1) for c in attrs[name].split(",") if c.strip()]
                attrs[name] = ", ".join(" ".join([self._asset(e[0]), *e[1:]]).strip() for e in entries)
            elif name == "style":
                attrs[name] = self._css(attrs[name])
        if tag in ("iframe", "frame") and attrs.get("src") and not attrs["src"].strip().startswith(("about:", "data:", "javascript:")):
            absolute, page, asset = self._look(attrs["src"])
            attrs["src"] = page or asset or absolute or attrs["src"]
        elif tag == "link" and attrs.get("href"):
            absolute = self._look(attrs["href"])[0]
            attrs["href"] = self._asset(attrs["href"]) if self._kind(attrs) == "asset" else absolute or attrs["href"]
        elif tag == "meta" and "refresh" in (attrs.get("http-equiv") or "").lower() and (m := _REFRESH.match(attrs.get("content") or "")):
            absolute, page, _ = self._look(m[2])
            if page or absolute:
                attrs["content"] = f"{m[1]}; url={page or absolute}"
        if tag in ("script", "link"):
            attrs.pop("integrity", None)
            attrs.pop("crossorigin", None)

    def rewrite(self, text: str) -> str:
        out, at, charset = [], 0, False
        top = after_html = before_end = None  # places in ``out``
        look = 0
        while (m := _TOKEN.search(text, look)) is not None:
            look = m.end()
            if m["end"] is not None:
                tag = m["end"].lower()
                if tag == "body" or (tag == "html" and before_end is None):
                    out.append(text[at : m.start()])
                    before_end, at = len(out), m.start()
                continue
            if m["name"] is None or not m["close"]:
                continue
            tag = m["name"].lower()
            out.append(text[at : m.start()])
            at = m.end()
            if tag == "base":
                continue
            attrs: dict[str, str | None] = {}
            for k, v in _ATTR.findall(m["attrs"]):
                attrs.setdefault(k.lower(), None if not v else entities.unescape(v[1:-1] if v[0] in "\"'" else v))
            before = dict(attrs)
            self.tag(tag, attrs)
            if tag == "meta" and not charset and (attrs.get("charset") or (attrs.get("http-equiv") or "").lower() == "content-type"):
                attrs = {k: v for k, v in attrs.items() if k not in ("http-equiv", "content")} | {"charset": "utf-8"}
                charset = True
            if attrs == before:
                out.append(m[0])
            else:
                out.append(f"<{m['name']}" + "".join(f" {k}" if v is None else f' {k}="{entities.escape(v)}"' for k, v in attrs.items()) + (" />" if m["attrs"].endswith("/") else ">"))
            if tag in _CLOSES:  # a body that is no markup
                close = _CLOSES[tag].search(text, at)
                look = close.start() if close else len(text)
                if tag == "style":
                    out.append(self._css(text[at:look]))
                    at = look
            if tag == "head" and top is None:
                top = len(out)
            elif tag == "html" and after_html is None:
                after_html = len(out)
        out.append(text[at:])
        if self.nav and NAV_ID not in text:
            bar = f'<div id="{NAV_ID}"><a href="{entities.escape(self.home)}">Site map</a> <a href="{entities.escape(self.live)}" target="_blank" rel="noopener">Live page</a></div>'
            out.insert(len(out) if before_end is None else before_end, bar)
        if not charset:  # first in the head, or where that would be
            declared = _DOCTYPE.match(out[0])
            if top is None and after_html is None and declared:
                out[0:1] = [declared[0], out[0][declared.end() :]]
            out.insert(next((k for k in (top, after_html) if k is not None), int(declared is not None)), '<meta charset="utf-8">')
        return "".join(out)


def _singly(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one at a time: of a batch only one page's text and references are Python objects, however many rows it has."""
    for batch in batches:
        columns = batch.columns
        for k in range(batch.num_rows):
            yield tuple(column[k].as_py() for column in columns)
        del batch, columns  # before the next one is read


def _packed(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows that end once the texts in column ``text`` pass ``HELD``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text])
        if size > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rewrite(nav: bool):
    def one(page_id: int, url: str, home: str, html: str | None, refs: list[dict] | None) -> tuple:
        page = _Page({r["raw"]: (r["absolute"], r["page"], r["asset"]) for r in refs or ()}, home, url, nav)
        return page_id, page.rewrite(html or ""), page.n_local, page.n_remote

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("html", pa.string()), ("n_local", pa.int64()), ("n_remote", pa.int64())])
        return _packed((one(*row) for row in _singly(batches)), schema, 1)

    return run


def _located(refs: DataFrame, captured: DataFrame | None, assets: DataFrame | None) -> DataFrame:
    """``refs`` (key, path, ...) with ``page`` and ``asset``: relative links from ``path`` to what is captured under the key."""
    for name, there in (("page", captured), ("asset", assets)):
        if there is None:
            refs = refs.withColumn(name, F.lit(None).cast("string"))
        else:
            refs = refs.join(there.select("key", F.col("path").alias("to")), "key", "left").withColumn(name, U.relative_link(F.col("path"), F.col("to"))).drop("to")
    return refs


def _rewrite_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(key: str, path: str, css: str | None, refs: list[dict] | None) -> tuple:
        return key, path, _Page({r["raw"]: (r["absolute"], None, r["asset"]) for r in refs or ()}, "", "", False)._css(css or "")

    return _packed((one(*row) for row in _singly(batches)), pa.schema([(name, pa.string()) for name in ("key", "path", "css")]), 2)


def rewrite_sheets(sheets: DataFrame, assets: DataFrame) -> DataFrame:
    """(key, path, css) of style sheets (key, url, path, css): what they import or name becomes a relative link where it is an asset.

    Each sheet needs only the paths of what it names, not their texts, so sheets that name each other in a circle are no
    special case. ``assets`` (key, path) are those within the depth that ``sheet_closure`` took.
    """
    css = F.coalesce("css", F.lit(""))
    raws = F.array_distinct(F.concat(H.css_imports(css), H.css_urls(css)))
    refs = sheets.select(F.col("key").alias("sheet"), "url", "path", F.explode_outer(raws).alias("raw")).where("raw <> ''")
    canon = refs.withColumn("c", U.canonical(F.col("raw"), F.col("url"))).where("c IS NOT NULL").select("sheet", "path", "raw", F.col("c.fetch_url").alias("absolute"), F.col("c.key").alias("key"))
    maps = _located(canon, None, assets).groupBy("sheet").agg(F.collect_list(F.struct("raw", "absolute", "asset")).alias("refs"))
    rows = sheets.join(maps, F.col("key") == F.col("sheet"), "left").select("key", "path", "css", "refs")
    return rows.mapInArrow(_rewrite_sheets, "key string, path string, css string")


def sheet_closure(sheets: DataFrame, start: DataFrame, scope: Scope | None = None) -> DataFrame:
    """(key, depth) of what ``start`` (key) sheets lead to by imports and urls, ``css_depth`` steps at most; circles end at what was seen."""
    scope = scope or Scope()
    css = F.coalesce("css", F.lit(""))
    named = sheets.select(F.col("key").alias("src"), "url", F.posexplode_outer(F.array_distinct(F.concat(H.css_imports(css), H.css_urls(css)))).alias("pos", "raw")).where("raw IS NOT NULL")
    edges = named.select("src", U.canonical(F.col("raw"), F.col("url"))["key"].alias("dst"), "pos").where("dst IS NOT NULL")
    seeds = start.select("key", F.lit(0).cast("long").alias("seq"))
    return frontier.crawl(edges, seeds, Scope(max_depth=scope.css_depth, max_pages=0))[0].select("key", "depth")


def rewrite_pages(pages: DataFrame, captured: DataFrame, assets: DataFrame | None = None, scope: Scope | None = None, nav: bool = True) -> DataFrame:
    """(page_id, html, n_local, n_remote) of ``pages`` (page_id, url, path, html).

    ``captured`` and ``assets`` have ``key`` and ``path``. References of a page to what is captured become
    relative links, others absolute URLs; base elements, integrity and crossorigin go, the charset is UTF-8, and a link to the site map
    is put in once.
    """
    scope = scope or Scope()
    html, url, tags = F.coalesce("html", F.lit("")), F.col("url"), F.col("tags")
    named = F.filter(H.tags(html), lambda t: F.contains(t, F.lit("=")))  # others name nothing
    seen = pages.select("page_id", "path", H.base_url(html, url).alias("base"), named.alias("tags"), L.style_texts(html).alias("styles"))
    fragmentless = F.transform(L.page_refs(tags, scope), lambda r: F.when(F.startswith(r, F.lit("#")), r).otherwise(F.regexp_extract(r, "^([^#]*)", 1)))
    raws = F.array_distinct(F.concat(fragmentless, L.asset_refs_of(tags), L.css_refs_of(F.col("styles"), tags), L.link_refs(tags)))
    refs = seen.select("page_id", "path", "base", F.explode_outer(raws).alias("raw")).where("raw <> ''")
    canon = refs.withColumn("c", U.canonical(F.col("raw"), F.col("base"), scope.keep_query)).where("c IS NOT NULL").select("page_id", "path", "raw", F.col("c.fetch_url").alias("absolute"), F.col("c.key").alias("key"))
    found = _located(canon, captured, assets)
    maps = found.groupBy("page_id").agg(F.collect_list(F.struct("raw", "absolute", "page", "asset")).alias("refs"))
    rows = pages.join(maps, "page_id", "left").select("page_id", "url", U.relative_link(F.col("path"), F.lit("index.html")).alias("home"), "html", "refs")
    return rows.mapInArrow(_rewrite(nav), "page_id long, html string, n_local long, n_remote long")
