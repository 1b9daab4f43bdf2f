"""Telling walls (captchas, interstitials, rate limits, logins) from pages.

One CASE over a page's lower-cased html and visible text: the first rule that holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import fixed
from webloom.functions.html import visible_text
from webloom.functions.url import let, strip

KIND = "struct<kind:string,vendor:string,detail:string>"


def _any(text: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains(text, F.lit(n))
    return out


def _vendor(low: Column) -> Column:
    out = F
    for marker, name in [*fixed.CAPTCHA_MARKERS, *((n, n) for n in fixed.OTHER_VENDORS)]:
        out = out.when(F.contains(low, F.lit(marker)), name)
    return out.otherwise("unknown")


def detect(html: Column, title: Column, status: Column) -> Column:
    """struct(kind, vendor, detail) of a wall, or null for a page."""

    def decide(x: Column) -> Column:
        low, text, head = x["low"], x["text"], x["title"]
        short = F.length(text) <= fixed.SHORT_TEXT
        wall = lambda kind, vendor, detail: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in (("kind", kind), ("vendor", vendor), ("detail", detail))])
        code = F.substring(F.regexp_extract(text, fixed.ERROR_PATTERN, 0), -4, 4)
        http = F.concat(F.lit("http "), status.cast("string"))
        widget = F
        for marker, name in fixed.CAPTCHA_MARKERS:
            widget = widget.when(F.contains(low, F.lit(marker)), name)
        out = F.when(_any(low, fixed.INTERSTITIAL_MARKERS), wall(F.when(_any(low, ["turnstile", "cf-chl-widget"]), "captcha").otherwise("interstitial"), "cloudflare", "challenge platform"))
        out = out.when(short & (_any(low, ["cloudflare", "cf-error-details"]) | F.contains(text, F.lit("ray id"))) & text.rlike(fixed.ERROR_PATTERN), wall(F.when(code == fixed.RATE_LIMIT_ERROR, "rate-limit").otherwise("denied"), "cloudflare", F.concat(F.lit("error "), code)))
        out = out.when(_any(low, [m for m, _ in fixed.CAPTCHA_MARKERS]) & (short | F.coalesce(status.isin(403, 429), F.lit(False))), wall("captcha", widget, "captcha wall"))
        out = out.when(F.coalesce(status == 429, F.lit(False)) | (_any(text, fixed.RATE_PHRASES) & short), wall("rate-limit", "server", F.coalesce(F.nullif(http, F.lit("http 0")), F.lit("too many requests"))))
        out = out.when(F.coalesce(status.isin(403, 503), F.lit(False)) & short & (_any(text, fixed.WALL_PHRASES) | _any(head, fixed.WALL_PHRASES)), wall(F.when(status == 403, "denied").otherwise("interstitial"), _vendor(low), http))
        out = out.when(short & head.isin(fixed.WALL_TITLES), wall("interstitial", "cloudflare", "interstitial title"))
        out = out.when(short & _any(text, fixed.WALL_PHRASES[: fixed.CLEAR_PHRASES]), wall("interstitial", _vendor(low), "wall wording"))
        return out.when(short & _any(text, fixed.LOGIN_PHRASES), wall("login-wall", "site", "login required"))

    once = F.struct(F.lower(html).alias("low"), visible_text(html).alias("text"), F.lower(strip(F.coalesce(title, F.lit("")))).alias("title"))
    return F.when(F.coalesce(html, F.lit("")) != "", let(once, decide))


def human_clearable(kind: Column) -> Column:
    return kind.isin(fixed.CLEARABLE)


def describe(wall: Column) -> Column:
    """``vendor kind (detail)``."""
    return F.when(wall.isNotNull(), F.concat(wall["vendor"], F.lit(" "), wall["kind"], F.when(wall["detail"] == "", F.lit("")).otherwise(F.concat(F.lit(" ("), wall["detail"], F.lit(")")))))


def as_error(wall: Column) -> Column:
    return F.concat(F.lit(fixed.WALL_PREFIX), describe(wall))
