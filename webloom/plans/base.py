"""What plans share: registering queries with their SQL, small literal tables, SQL for canonical URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import fixed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the same in DuckDB SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def each_page(spark: SparkSession, sf_dir: str, schema: str, rows: list[tuple]) -> DataFrame:
    """Every page's number with each of the rows, which are a fixed list."""
    return pages(spark, sf_dir).select("page_id").crossJoin(F.broadcast(spark.createDataFrame(rows, schema)))


def quoted(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression with literal rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)})"


def each_page_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of every page's number with each of the literal rows."""
    return values(f"{name}_rows", columns, rows) + f", {name} AS (SELECT page_id, {name}_rows.* FROM pages, {name}_rows)"


def in_list(names: list[str]) -> str:
    return ", ".join(quoted(n) for n in names)


def any_in(text: str, names: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(n)})" for n in names) + ")"


_SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
_NET = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACES}|{_SPACES}$', '', 'g')"


def sql_fold(path: str) -> str:
    """A path without empty, ``.`` and ``..`` parts, by a fold over its parts."""
    fold = f"list_reduce(list_prepend('', string_split({path}, '/')), lambda a, s: CASE WHEN s IN ('', '.') THEN a WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END)"
    return f"(CASE WHEN regexp_matches({path}, '^//($|[^/])') THEN CASE WHEN {fold} = '' THEN '//' ELSE '/' || {fold} END WHEN {fold} = '' THEN '/' ELSE {fold} END)"


def sql_dots(path: str) -> str:
    return f"list_reduce(list_prepend('', string_split({path}, '/')), lambda a, s: CASE WHEN s = '.' THEN a WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END)"


def _restore(x: str, codes: str) -> str:
    for code, c in [x.split("=", 1) for x in codes.split()]:
        x = f"replace({x}, '%{code}', {quoted(c)})"
    return x


def sql_quote(x: str) -> str:
    """Percent encoding that keeps what a path may have, percent signs last."""
    return _restore(f"url_encode({x})", "2F=/ 3A=: 40=@ 21=! 24=$ 26=& 27=' 28=( 29=) 2A=* 2B=+ 2C=, 3B=; 3D== 25=%")


def sql_form(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def sql_ext(path: str) -> str:
    return rf"regexp_extract(regexp_extract({path}, '([^/]*)$', 1), '^\.*[^.].*?(\.[^.]*)$', 1)"


def sql_path(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def sql_host(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://([^/?#:]*)', 1)"


def sql_page_like(url: str) -> str:
    e = f"lower({sql_ext(sql_path(url))})"
    return f"({e} IN ({in_list(fixed.PAGE_EXTENSIONS)}) OR ({e} NOT IN ({in_list(fixed.ASSET_EXTENSIONS)}) AND length({e}) > 5))"


def sql_canonical(out: str, source: str, raw: str = "raw", base: str = "base", keep_query: bool = True) -> str:
    """Common table expressions that end in ``out``: the rows of ``source`` with ``fetch_url`` and ``key``."""
    skip = "|".join(fixed.SKIP_SCHEMES)
    pairs = r"""list_filter(list_transform(list_filter(string_split(coalesce(q_, ''), '&'), lambda x: x <> ''),
      lambda x: {'k': url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))}),
      lambda p: NOT regexp_matches(p.k, '%s'))""" % fixed.TRACKING if keep_query else "CAST([] AS STRUCT(k VARCHAR, v VARCHAR)[])"
    joined = lambda p: f"array_to_string(list_transform({p}, lambda p: {sql_form('p.k')} || '=' || {sql_form('p.v')}), '&')"
    tail = lambda p: f"CASE WHEN len({p}) = 0 THEN '' ELSE '?' || {joined(p)} END"
    return rf"""
{out}_a AS (SELECT *, regexp_replace({sql_strip(raw)}, '[\n\r\t]', '', 'g') AS r_, coalesce({base}, '') AS b_ FROM {source}),
{out}_b AS (SELECT *, lower(regexp_extract(r_, '{_SCHEME}', 1)) AS rs_, regexp_matches(r_, '{_NET}') AS rh_, regexp_extract(r_, '{_NET}', 1) AS rn_, regexp_extract(r_, '{_PATH}', 1) AS rp_, regexp_extract(r_, '^[^#?]*\?([^#]*)', 1) AS rq_,
  lower(regexp_extract(b_, '{_SCHEME}', 1)) AS bs_, regexp_extract(b_, '{_NET}', 1) AS bn_, coalesce(nullif(regexp_extract(b_, '{_PATH}', 1), ''), '/') AS bp_, regexp_extract(b_, '^[^#?]*\?([^#]*)', 1) AS bq_ FROM {out}_a),
{out}_c AS (SELECT *, bs_ <> '' AND rs_ IN ('', bs_) AND NOT rh_ AS in_, coalesce(nullif(rs_, ''), bs_) AS s_,
  CASE WHEN rp_ LIKE '/%' THEN rp_ ELSE regexp_replace(regexp_replace(bp_, '[^/]*$', '') || rp_, '/+', '/', 'g') END AS m_ FROM {out}_b),
{out}_d AS (SELECT *, CASE WHEN in_ THEN bn_ ELSE rn_ END AS n_, CASE WHEN in_ AND rp_ = '' AND rq_ = '' THEN bq_ ELSE rq_ END AS q_,
  CASE WHEN NOT in_ THEN rp_ WHEN rp_ = '' THEN bp_ ELSE CASE WHEN regexp_matches(m_, '(^|/)\.\.?(/|$)') THEN regexp_replace('/' || substr({sql_dots("m_")} || CASE WHEN regexp_matches(m_, '(^|/)\.\.?$') THEN '/' ELSE '' END, 2), '^//', '/') ELSE m_ END END AS p0_ FROM {out}_c),
{out}_e AS (SELECT *, coalesce(nullif(p0_, ''), '/') AS p_, regexp_replace(lower(regexp_extract(regexp_extract(n_, '([^@]*)$', 1), '^(\[[^\]]*\]|[^:]*)', 1)), '\.+$', '') AS h_,
  regexp_extract(regexp_extract(n_, '([^@]*)$', 1), '^(?:\[[^\]]*\]|[^:]*):(.*)$', 1) AS port_, {pairs} AS kv_ FROM {out}_d),
{out}_f AS (SELECT *, {sql_fold("p_")} AS f_ FROM {out}_e),
{out}_g AS (SELECT *, {sql_quote("url_decode(CASE WHEN p_ LIKE '%/' AND f_ NOT LIKE '%/' THEN f_ || '/' ELSE f_ END)")} AS path_,
  s_ || '://' || h_ || CASE WHEN port_ = '' OR (s_ = 'http' AND port_ = '80') OR (s_ = 'https' AND port_ = '443') THEN '' ELSE ':' || CAST(TRY_CAST(port_ AS INT) AS VARCHAR) END AS front_,
  r_ <> '' AND r_ NOT LIKE '#%' AND NOT regexp_matches(r_, '(?i)^({skip}):') AND s_ IN ('http', 'https') AND h_ <> '' AND (port_ = '' OR (regexp_matches(port_, '^[0-9]+$') AND TRY_CAST(port_ AS INT) <= 65535)) AS ok_ FROM {out}_f),
{out} AS (SELECT * EXCLUDE (r_, b_, rs_, rh_, rn_, rp_, rq_, bs_, bn_, bp_, bq_, in_, s_, m_, n_, q_, p0_, p_, h_, port_, kv_, f_, path_, front_, ok_),
  CASE WHEN ok_ THEN front_ || path_ || {tail("kv_")} END AS fetch_url,
  CASE WHEN ok_ THEN front_ || coalesce(nullif(rtrim(path_, '/'), ''), '/') || {tail("list_sort(kv_)")} END AS key FROM {out}_g)"""


_SQL_TAG = r"""<[A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
#: Start tags of each page: (page_id, url, pos, tag).
SQL_TAGS = rf"""
bare AS (SELECT *, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>', '\1', 'g') AS b FROM {{source}}),
tags AS (SELECT * EXCLUDE (b, ts), ts[pos] AS tag, lower(regexp_extract(ts[pos], '^<([A-Za-z][^\s/>]*)', 1)) AS name FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS pos FROM (SELECT *, regexp_extract_all(b, '{_SQL_TAG}') AS ts FROM bare)))"""


def sql_unescape(x: str) -> str:
    for name, c in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {quoted(name)}, {quoted(c)})"
    return x


def sql_attr(tag: str, name: str) -> str:
    """The first attribute of a name: the tag is cut into all its attributes, which are then looked through."""
    parts = rf"""regexp_extract_all(regexp_replace({tag}, '^<[A-Za-z][^\s/>]*', ''), '[^\s/>="''][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"''][^\s>]*))?')"""
    own = rf"list_filter({parts}, lambda x: lower(regexp_extract(x, '^([^\s=]+)', 1)) = '{name}')[1]"
    value = rf"""regexp_replace(regexp_replace({own}, '(?s)^[^\s=]+\s*=\s*', ''), '(?s)^["''](.*)["'']$', '\1')"""
    return f"CASE WHEN contains({own}, '=') THEN {sql_unescape(value)} END"


#: Links of pages before they are resolved: (page_id, url, pos, raw).
SQL_LINKS = SQL_TAGS.replace("{source}", "pages") + f""",
hrefs AS (SELECT page_id, url, CAST(pos AS INT) AS pos, {sql_strip(sql_attr("tag", "href"))} AS raw FROM tags WHERE name = 'a')""" + """,
links AS (SELECT * FROM hrefs WHERE raw <> '')"""
