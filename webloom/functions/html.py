"""HTML as columns: tags, attributes, titles, visible text, styles."""

from __future__ import annotations

import re
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import fixed, markup
from webloom.functions.url import let, strip

CSS_URL, CSS_IMPORT, META_REFRESH = (f"(?i){p}" for p in (fixed.CSS_URL, fixed.CSS_IMPORT, fixed.META_REFRESH))
#: A character reference, or what stands between two; a name without its semicolon is one only where the text doesn't go on with it.
_PIECE = r"&#[0-9]{1,7};?|&#[xX][0-9A-Fa-f]{1,6};?|&[A-Za-z][A-Za-z0-9]*;|&[A-Za-z][A-Za-z0-9]*(?![A-Za-z0-9;=])|[^&]+|&"
#: The named references of HTML as one text, to be looked up in.
_NAMED = "".join(f"\x01{name}\x02{char}" for name, char in entities.html5.items()) + "\x01"

#: The commonest references, in the order in which they are replaced.
_COMMON = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def tags(html: Column, names: list[str] | None = None) -> Column:
    """All start tags, or those of some elements, in document order; comments and bodies that are no markup (``markup.RAW``) are passed over."""
    return F.filter(F.regexp_extract_all(html, F.lit("(?i)" + markup.start_tags(names)), F.lit(3)), lambda t: t != "")


def bodies(html: Column, name: str) -> Column:
    """Texts of the elements of one name, which is one of ``markup.RAW``; blank ones are left out."""
    return F.filter(F.regexp_extract_all(html, F.lit("(?i)" + markup.bodies(name)), F.lit(1)), lambda t: t != "")


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, rf"^<({markup.NAME})", 1))


def unescape(text: Column) -> Column:
    """Character references, numeric ones and the named ones of HTML, decoded; what is none stays."""
    named = lambda x: F.split_part(F.split_part(F.lit(_NAMED), F.concat(F.lit("\x01"), F.substring(x, 2, 64), F.lit("\x02")), F.lit(2)), F.lit("\x01"), F.lit(1))

    def decoded(x: Column) -> Column:
        digits = F.rtrim(F.substring(x, 3, 9), F.lit(";"))
        code = F.when(x.rlike("^&#[0-9]"), digits.cast("int")).when(x.rlike("^&#[xX]"), F.conv(F.substring(digits, 2, 8), 16, 10).cast("int"))
        none = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        char = F.when(none, "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(code.isNotNull(), char).when(F.startswith(x, F.lit("&")), F.coalesce(F.nullif(named(x), F.lit("")), x)).otherwise(x)

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(0)), decoded), "")).otherwise(t))


def escape(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def _upto(name: str) -> str:
    """A tag up to its first attribute of a name: other attributes are passed whole."""
    here, gap = rf"{re.escape(name)}(?=[ \t\n\f\r=/>])", r"[ \t\n\f\r/]*+"
    return rf"(?i)^<{markup.NAME}(?:{gap}(?!{here}){markup.ATTR})*+{gap}{here}"


def attr_raw(tag: Column, name: str) -> Column:
    """An attribute's value as it is written, with its quotes; empty if the tag has none."""
    return F.regexp_extract(tag, rf"{_upto(name)}{markup.SPACE}*+={markup.SPACE}*+({markup.VALUE})", 1)


def attr_value(raw: Column) -> Column:
    """What a written value stands for; null for none."""

    def value(x: Column) -> Column:
        return F.when(x != "", unescape(F.when(x.rlike("^[\"']"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)))

    return let(raw, value)


def attr(tag: Column, name: str) -> Column:
    """An attribute's value, references decoded; null if the tag has none, or one without a value."""
    return attr_value(attr_raw(tag, name))


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(_upto(name))


def title(html: Column) -> Column:
    return unescape(strip(F.regexp_extract(html, rf"(?i)<title(?=[ \t\n\f\r/>])[^>]*+>([\s\S]*?)(?:</title(?=[ \t\n\f\r/>])|{markup.END})", 1)))


def written_title(html: Column) -> Column:
    """The first title that is closed, as it is written but for white space around it and the commonest references, which end in a semicolon.

    ``title`` reads more of it as browsers do: all references, those without a semicolon too, and a title that the page's end cuts off.
    """
    text = strip(F.regexp_extract(html, r"(?is)\A(?>.*?<title)[^>]*+>(.*?)</title>", 1))
    for name, char in _COMMON:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def visible_text(html: Column, limit: int = fixed.SCANNED) -> Column:
    """The text of a page's first ``limit`` characters, in lower case, white space squeezed."""
    cut = F.regexp_replace(F.substring(html, 1, limit), r"(?is)<(script|style|noscript|template)\b.*?</\1>", " ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(cut, "<[^>]+>", " "), r"(?U)\s+", " ")))


def link_kind(tag: Column) -> Column:
    """Of a link tag: ``asset`` or ``absolute``."""
    rels = F.split(F.lower(F.coalesce(attr(tag, "rel"), F.lit(""))), r"\s+")
    within = lambda names: F.arrays_overlap(rels, F.array(*[F.lit(n) for n in names]))
    hint = (F.coalesce(attr(tag, "as"), F.lit("")) != "") | (F.coalesce(attr(tag, "type"), F.lit("")) != "")
    return F.when(within(fixed.ASSET_RELS), "asset").when(within(fixed.ABSOLUTE_RELS), "absolute").when(hint, "asset").otherwise("absolute")


def srcset(value: Column) -> Column:
    """array(struct(url, descriptor)) of a srcset, in order."""
    chunks = F.filter(F.transform(F.split(value, ","), strip), lambda c: c != "")
    return F.transform(chunks, lambda c: F.struct(F.regexp_extract(c, r"^(\S+)", 1).alias("url"), F.regexp_extract(c, r"(?s)^\S+\s+(.*)$", 1).alias("descriptor")))


def meta_refresh(content: Column) -> Column:
    """The target of a refresh, or null."""
    return F.nullif(F.regexp_extract(content, META_REFRESH, 2), F.lit(""))


def css_urls(css: Column) -> Column:
    return F.transform(F.regexp_extract_all(css, F.lit(CSS_URL), F.lit(2)), strip)


def css_imports(css: Column) -> Column:
    return F.transform(F.regexp_extract_all(css, F.lit(CSS_IMPORT), F.lit(2)), strip)


def lazy_src(tag: Column) -> Column:
    """``src``, or else the first lazily loaded source that isn't empty."""
    own = F.nullif(attr(tag, "src"), F.lit(""))
    return F.coalesce(own, *[F.nullif(attr(tag, name), F.lit("")) for name in fixed.LAZY_SRC])


def has_charset(html: Column) -> Column:
    return F.exists(tags(html), lambda t: (tag_name(t) == "meta") & (F.coalesce(attr(t, "charset"), F.lit("")) != ""))


def strip_integrity(html: Column) -> Column:
    """Scripts and links without integrity and crossorigin."""
    out = html
    for name in ("integrity", "crossorigin"):
        out = F.regexp_replace(out, rf"(?is)(<(?:script|link)\b[^>]*?)\s+{name}(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/>])", "$1")
    return out


def one_decimal(n: Column, unit: float) -> Column:
    """A whole number that isn't negative, in units of a power of two, with one decimal; only what stands halfway exactly goes to the even digit.

    ``format_string`` would round it up, as the shortest digits of a double read. What is behind the point, times ten, is exact.
    """
    x = n.cast("double") / unit
    whole = F.floor(x)
    tenths = F.rint((x - whole) * 10).cast("long")
    return F.concat((whole + F.when(tenths == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def human_bytes(n: Column) -> Column:
    """A size in steps of 1,024; whole bytes, else one decimal."""
    out = F.when(n < 1024, F.concat(F.rint(n.cast("double")).cast("long").cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 2):
        out = out.when(n < 1024.0**k, F.concat(one_decimal(n, 1024.0 ** (k - 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(one_decimal(n, 1024.0**5), F.lit(" PB")))


def base_url(html: Column, page_url: Column) -> Column:
    """The first base element's target, or the page's own URL."""
    from webloom.functions.url import canonical

    first = F.try_element_at(F.filter(tags(html), lambda t: (tag_name(t) == "base") & has_attr(t, "href")), F.lit(1))
    target = F.when(html.rlike("(?i)<base[\\s/]"), let(attr(first, "href"), lambda h: canonical(h, page_url)["fetch_url"]))
    return F.coalesce(target, page_url)
