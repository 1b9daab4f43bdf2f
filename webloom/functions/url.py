"""URLs as columns: canonical form and identity, scope, and where a mirror keeps them.

Everything is built-in SQL functions. What needs a value several times binds it by ``let``, so that it is
computed once for each row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import fixed

#: What counts as white space around a URL.
_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
_RESTORE = ["/", "~", ":", "@", "!", "$", "&", "'", "(", ")", "+", ",", ";", "="]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_WS}|{_WS}$", "")


def percent_decode(text: Column, plus: bool = False) -> Column:
    """UTF-8 percent decoding; what is no escape stays. ``plus``: a plus is a space."""
    sound = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(sound if plus else F.replace(sound, F.lit("+"), F.lit("%2B")))


def percent_encode(text: Column, keep: list[str], star: bool = True) -> Column:
    """Percent encoding of all but letters, digits, ``-._`` and ``keep`` (``%`` comes last there)."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    if not star:
        out = F.replace(out, F.lit("*"), F.lit("%2A"))
    for c in keep:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def _form_encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def split(url: Column) -> Column:
    """struct(scheme, netloc, path, query), with nulls for what is absent."""
    has = lambda p: url.rlike(p)
    part = lambda k: F.regexp_extract(url, _PARTS, k)
    return F.struct(
        F.nullif(F.lower(part(1)), F.lit("")).alias("scheme"), F.when(has(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), part(2)).alias("netloc"), part(3).alias("path"), F.when(has(r"^[^#?]*\?"), part(4)).alias("query")
    )


def host_port(netloc: Column) -> Column:
    """struct(host, port text) of an authority; brackets of an IPv6 host stay."""
    info = F.regexp_extract(netloc, r"([^@]*)$", 1)
    return F.struct(F.regexp_replace(F.lower(F.regexp_extract(info, r"^(\[[^\]]*\]|[^:]*)", 1)), r"\.+$", "").alias("host"), F.regexp_extract(info, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1).alias("port"))


def fold_path(path: Column) -> Column:
    """A path from the root without empty, ``.`` and ``..`` parts; exactly two leading slashes survive."""
    folded = F.aggregate(F.split(path, "/"), F.lit(""), lambda at, s: F.when(s.isin("", "."), at).when(s == "..", F.regexp_replace(at, "/[^/]*$", "")).otherwise(F.concat(at, F.lit("/"), s)))
    return let(folded, lambda f: F.when(path.rlike("^//($|[^/])"), F.concat(F.when(f == "", F.lit("//")).otherwise(F.concat(F.lit("/"), f)))).when(f == "", F.lit("/")).otherwise(f))


def _without_dots(path: Column) -> Column:
    """Dot parts taken out as a reference is resolved: empty parts count as parts, and a last part of dots names a folder."""
    kept = F.aggregate(F.split(path, "/"), F.lit(""), lambda a, s: F.when(s == "..", F.regexp_replace(a, "/[^/]*$", "")).when(s == ".", a).otherwise(F.concat(a, F.lit("/"), s)))
    kept = F.substring(F.when(path.rlike(r"(^|/)\.\.?$"), F.concat(kept, F.lit("/"))).otherwise(kept), 2, 1 << 30)
    rooted = let(kept, lambda k: F.when(F.startswith(k, F.lit("/")), k).otherwise(F.concat(F.lit("/"), k)))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), rooted).otherwise(path)


def resolve(raw: Column, base: Column | None) -> Column:
    """struct(scheme, netloc, path, query) of a reference against a base URL."""
    own = split(raw)
    if base is None:
        return own

    def joined(x: Column) -> Column:
        r, b = x["r"], x["b"]
        relative = b["scheme"].isNotNull() & F.coalesce(r["scheme"], b["scheme"]).eqNullSafe(b["scheme"]) & r["netloc"].isNull()
        bare = r["path"] == ""
        folder = F.regexp_replace(F.when(b["path"] == "", F.lit("/")).otherwise(b["path"]), "[^/]*$", "")
        merged = F.when(F.startswith(r["path"], F.lit("/")), r["path"]).otherwise(F.regexp_replace(F.concat(folder, r["path"]), "/{2,}", "/"))
        path = F.when(bare, b["path"]).otherwise(let(merged, _without_dots))
        query = F.when(bare & F.coalesce(r["query"] == "", F.lit(True)), b["query"]).otherwise(r["query"])
        inside = F.struct(b["scheme"].alias("scheme"), b["netloc"].alias("netloc"), path.alias("path"), query.alias("query"))
        outside = F.struct(F.coalesce(r["scheme"], b["scheme"]).alias("scheme"), r["netloc"].alias("netloc"), r["path"].alias("path"), r["query"].alias("query"))
        return F.when(relative, inside).otherwise(outside)

    return let(F.struct(own.alias("r"), split(F.coalesce(base, F.lit(""))).alias("b")), joined)


def query_pairs(query: Column, keep_query: bool = True) -> Column:
    """Decoded (k, v) pairs in order, without those that only track."""
    if not keep_query:
        return F.array().cast("array<struct<k:string,v:string>>")
    cut = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda x: x != "")
    pairs = F.transform(cut, lambda x: F.struct(percent_decode(F.regexp_extract(x, "^([^=]*)", 1), True).alias("k"), percent_decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1), True).alias("v")))
    return F.filter(pairs, lambda p: ~p["k"].rlike(fixed.TRACKING))


def _joined_pairs(pairs: Column) -> Column:
    text = F.array_join(F.transform(pairs, lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&")
    return let(text, lambda t: F.when(t == "", t).otherwise(F.concat(F.lit("?"), t)))


def canonical(raw: Column, base: Column | None = None, keep_query: bool = True) -> Column:
    """struct(fetch_url, key) of a reference, or null if it can't be fetched.

    ``key`` is a page's identity: its parameters are sorted and slashes at the end of its path are gone.
    Null for null, empty and fragment-only references, schemes other than http(s), a missing host, and a bad port.
    """
    text = F.regexp_replace(strip(raw), "[\n\r\t]", "")
    skipped = "^(?i)(" + "|".join(fixed.SKIP_SCHEMES) + "):"

    def build(p: Column) -> Column:
        def end(x: Column) -> Column:
            hp, path = x["hp"], x["path"]
            port = F.when(hp["port"].rlike("^[0-9]{1,5}$"), hp["port"].cast("int"))
            ok = p["scheme"].isin("http", "https") & (hp["host"] != "") & ((hp["port"] == "") | F.coalesce(port <= 65535, F.lit(False)))
            default = F.when(p["scheme"] == "http", 80).otherwise(443)
            netloc = F.concat(hp["host"], F.when(port.isNull() | (port == default), F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string"))))
            front = F.concat(p["scheme"], F.lit("://"), netloc)
            bare = F.regexp_replace(path, "/+$", "")
            return F.when(
                ok,
                F.struct(F.concat(front, path, _joined_pairs(x["pairs"])).alias("fetch_url"), F.concat(front, F.when(bare == "", F.lit("/")).otherwise(bare), _joined_pairs(F.array_sort(x["pairs"]))).alias("key")),
            )

        whole = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
        folded = let(whole, lambda w: let(fold_path(w), lambda f: F.when(F.endswith(w, F.lit("/")) & ~F.endswith(f, F.lit("/")), F.concat(f, F.lit("/"))).otherwise(f)))
        path = percent_encode(percent_decode(folded), [*_RESTORE, "%"])
        return let(F.struct(host_port(F.coalesce(p["netloc"], F.lit(""))).alias("hp"), path.alias("path"), query_pairs(p["query"], keep_query).alias("pairs")), end)

    def start(t: Column) -> Column:
        return F.when((t == "") | F.startswith(t, F.lit("#")) | t.rlike(skipped) | t.isNull(), F.lit(None)).otherwise(let(resolve(t, base), build))

    return let(text, start)


def url_of_key(key: Column, keep_query: bool = True) -> Column:
    """The URL to fetch for an identity, which is a URL itself; null if it can't be fetched."""
    return canonical(key, None, keep_query)["fetch_url"]


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def origin(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1), F.lit("/"))


def strip_fragment(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^([^#]*)", 1)


def registrable_domain(host: Column) -> Column:
    """A host's last two labels, or three where the last but one is a common second level."""
    p = F.split(host, r"\.")
    n = F.size(p)
    two_level = F.element_at(p, -2).isin(fixed.SECOND_LEVEL) & (F.length(F.element_at(p, -1)) <= 3)
    return F.when(n <= 2, host).when(two_level, F.array_join(F.slice(p, -3, 3), ".")).otherwise(F.array_join(F.slice(p, -2, 2), "."))


def extension(path: Column) -> Column:
    """The extension of a path's last part with its dot; dots that begin the part don't count."""
    return F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), r"^\.*[^.].*?(\.[^.]*)$", 1)


def looks_like_page(url: Column) -> Column:
    ext = F.lower(extension(path_of(url)))
    return let(ext, lambda e: e.isin(fixed.PAGE_EXTENSIONS) | (~e.isin(fixed.ASSET_EXTENSIONS) & (F.length(e) > 5)))


def host_in_scope(host: Column, scope) -> Column:
    """``scope``: see webloom.functions.scope.Scope."""
    ok = F.lower(host).isin(sorted(scope.allowed_hosts)) if scope.allowed_hosts else F.lit(False)
    if scope.include_subdomains:
        for name in [scope.start_domain(), *sorted(scope.extra_domains)]:
            ok = ok | (F.lower(host) == name) | F.endswith(F.lower(host), F.lit("." + name))
    return ok


def in_scope(url: Column, scope) -> Column:
    """Host, path prefix, any of the wanted patterns and none of the unwanted ones (Java regular expressions)."""
    ok = host_in_scope(host_of(url), scope)
    if scope.path_prefix:
        ok = ok & F.startswith(path_of(url), F.lit(scope.path_prefix))
    if scope.include:
        ok = ok & F.exists(F.array(*[F.lit(p) for p in scope.include]), lambda p: F.regexp_like(url, p))
    for p in scope.exclude:
        ok = ok & ~url.rlike(p)
    return ok


def short_hash(text: Column, n: int = 8) -> Column:
    return F.substring(F.sha1(text), 1, n)


def safe_segment(segment: Column) -> Column:
    """A URL path part as a file name that every system takes, 90 bytes at most."""
    plain = F.regexp_replace(percent_decode(segment), r'[<>:"|?*\\/\x00-\x1f]', "_")
    plain = F.regexp_replace(strip(plain), "[. ]+$", "")

    def finish(s: Column) -> Column:
        ext = extension(s)
        stem = F.substring(s, F.lit(1), F.length(s) - F.length(ext))
        room = F.greatest(F.lit(1), fixed.SEGMENT_BYTES - F.length(ext) - 9)
        # The longest beginning whose UTF-8 bytes fit, whole characters only.
        fits = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(stem), room)), lambda k: F.octet_length(F.substring(stem, F.lit(1), k)) <= room))
        return F.when(F.octet_length(s) > fixed.SEGMENT_BYTES, F.concat(F.substring(stem, F.lit(1), fits), F.lit("_"), short_hash(s), ext)).otherwise(s)

    reserved = lambda s: F.upper(F.regexp_extract(s, r"^([^.]*)", 1)).isin(fixed.RESERVED_NAMES)
    return let(plain, lambda s: F.when(s == "", F.lit("_")).otherwise(let(F.when(reserved(s), F.concat(F.lit("_"), s)).otherwise(s), finish)))


def _segments(url: Column) -> Column:
    return F.transform(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), safe_segment)


def _host_segment(url: Column) -> Column:
    port = F.regexp_extract(url, r"^[a-z]+://(?:\[[^\]]*\]|[^/?#:]*):([0-9]+)", 1)
    default = F.when(F.startswith(url, F.lit("http:")), "80").otherwise("443")
    host = F.lower(host_of(url))
    return safe_segment(F.when((port == "") | (port == default), host).otherwise(F.concat(host, F.lit("_"), port)))


def _with_query(name: Column, url: Column) -> Column:
    query = query_of(url)
    ext = extension(name)
    return F.when(query == "", name).otherwise(F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(ext)), F.lit("__q"), short_hash(query), ext))


def _joined(top: str, url: Column, parts: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit(top), _host_segment(url), F.array_join(parts, "/"), name) if parts is None else F.array_join(F.concat(F.array(F.lit(top), _host_segment(url)), parts, F.array(name)), "/")


def page_path(url: Column) -> Column:
    """Where a mirror keeps a page."""

    def build(s: Column) -> Column:
        last = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(""))
        ext = extension(last)
        folder = (F.size(s) == 0) | F.endswith(path_of(url), F.lit("/")) | (ext == "")
        page = F.lower(ext).isin(fixed.PAGE_EXTENSIONS[1:])
        name = F.when(folder, F.lit("index.html")).when(page, F.concat(F.substring(last, F.lit(1), F.length(last) - F.length(ext)), F.lit(".html"))).otherwise(F.concat(last, F.lit(".html")))
        dirs = F.when(folder, s).otherwise(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
        return let(name, lambda n: _joined(fixed.PAGES_DIR, url, dirs, _with_query(n, url)))

    return let(_segments(url), build)


def type_extension(content_type: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in fixed.TYPE_EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.lower(strip(F.regexp_extract(F.coalesce(content_type, F.lit("")), "^([^;]*)", 1)))), F.lit(".bin"))


def asset_path(url: Column, content_type: Column) -> Column:
    """Where a mirror keeps an asset."""

    def build(s: Column) -> Column:
        s = F.when(F.size(s) == 0, F.array(F.lit("index"))).otherwise(s)
        last = F.element_at(s, -1)
        name = F.when(extension(last) == "", F.concat(last, type_extension(content_type))).otherwise(last)
        return let(name, lambda n: _joined(fixed.ASSETS_DIR, url, F.slice(s, F.lit(1), F.size(s) - 1), _with_query(n, url)))

    return let(_segments(url), build)


def relative_link(here: Column, there: Column) -> Column:
    """The reference from one file of a mirror to another."""

    def build(x: Column) -> Column:
        a, b = x["a"], x["b"]
        differs = F.array_position(F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False))), F.lit(False))
        same = (differs - 1).cast("int")
        steps = F.concat(F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b)))
        return F.when(F.size(steps) == 0, F.lit(".")).otherwise(F.array_join(steps, "/"))

    folder = lambda p: F.filter(F.split(F.regexp_extract(p, "^(.*)/[^/]*$", 1), "/"), lambda s: s != "")
    parts = F.struct(folder(here).alias("a"), F.filter(F.split(there, "/"), lambda s: s != "").alias("b"))
    return percent_encode(let(parts, build), [*_RESTORE])
