"""A crawl's settings from the options of a command line.

The flags are stated once, as a table; the parser and the settings are made from it. What only a fetcher needs (browser,
windows, waiting) is passed through in ``fetcher``: pages come from a table here, and whoever fills it reads those.
"""

from __future__ import annotations

import argparse
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webloom.functions import url as U
from webloom.functions.scope import Scope

#: Flag, short flag, kind (a type, ``list``, or what a switch sets), default, and the setting: one of Scope, of Run, or of the fetcher.
FLAGS: list[tuple[str, str | None, Any, Any, str]] = [
    ("output", "o", str, None, "run.output"), ("max-depth", "d", int, 3, "scope.max_depth"), ("max-pages", "n", int, 300, "scope.max_pages"), ("include-subdomains", None, True, False, "scope.include_subdomains"),
    ("domain", None, list, None, "scope.extra_domains"), ("path-prefix", None, str, None, "scope.path_prefix"), ("include", None, list, None, "scope.include"), ("exclude", None, list, None, "scope.exclude"),
    ("ignore-query", None, False, True, "scope.keep_query"), ("no-iframes", None, False, True, "scope.crawl_iframes"), ("delay", None, float, 0.4, "scope.delay"), ("retries", None, int, 2, "scope.max_retries"),
    ("backoff", None, float, 5.0, "scope.backoff"), ("max-asset-mb", None, float, 25.0, "scope.max_asset_mb"), ("no-assets", None, False, True, "run.assets"), ("ignore-robots", None, False, True, "run.robots"),
    ("no-sitemap", None, False, True, "run.sitemap"), ("resume", None, True, False, "run.resume"), ("rewrite-only", None, True, False, "run.rewrite_only"), ("no-nav", None, False, True, "run.nav"), ("clean-raw", None, False, True, "run.keep_raw"),
    ("cookies", None, str, None, "run.cookies"), ("save-cookies", None, str, None, "run.save_cookies"), ("no-solve", None, False, True, "run.gate"), ("workers", "w", int, 4, "fetcher.workers"), ("browser", None, ("chrome", "firefox"), "chrome", "fetcher.browser"),
    ("no-headless", None, False, True, "fetcher.headless"), ("window-size", None, str, "1440,1000", "fetcher.window_size"), ("user-agent", None, str, None, "fetcher.user_agent"), ("timeout", None, int, 30, "fetcher.timeout"), ("wait", None, float, 1.2, "fetcher.wait"),
    ("no-scroll", None, False, True, "fetcher.scroll"), ("profile", None, str, None, "fetcher.profile"), ("manual-login", None, True, False, "fetcher.manual_login"), ("challenge-wait", None, float, 12.0, "fetcher.challenge_wait"), ("block-media", None, True, False, "fetcher.block_media"),
    ("verbose", "v", True, False, "fetcher.verbose"), ("quiet", "q", True, False, "fetcher.quiet"),
]


@dataclass(frozen=True)
class Run:
    """One crawl: where it starts, what it covers, what it does."""

    start_url: str
    start_key: str
    scope: Scope
    output: str
    assets: bool = True
    robots: bool = True
    sitemap: bool = True
    resume: bool = False
    rewrite_only: bool = False
    nav: bool = True
    keep_raw: bool = True
    cookies: str | None = None
    save_cookies: str | None = None
    gate: bool = True
    fetcher: dict[str, Any] = field(default_factory=dict)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="webloom", description="Settings of a crawl.")
    out.add_argument("url")
    for flag, short, kind, default, to in FLAGS:
        names = [f"--{flag}", *([f"-{short}"] if short else [])]
        if isinstance(kind, bool):
            out.add_argument(*names, dest=to, action="store_const", const=kind, default=default)
        elif kind is list:
            out.add_argument(*names, dest=to, action="append", default=[])
        elif isinstance(kind, tuple):
            out.add_argument(*names, dest=to, choices=kind, default=default)
        else:
            out.add_argument(*names, dest=to, type=kind, default=default)
    return out


def parse(spark: SparkSession, argv: list[str]) -> Run:
    """The run that ``argv`` asks for; ``ValueError`` if its URL can't be fetched or a pattern is none."""
    given = vars(parser().parse_args(argv))
    of = lambda kind: {k.partition(".")[2]: v for k, v in given.items() if k.startswith(f"{kind}.")}
    scope, run, fetcher = of("scope"), of("run"), of("fetcher")
    start = spark.range(1).select(U.canonical(F.lit(given["url"]), keep_query=scope["keep_query"]).alias("c")).select("c.*", U.host_of(F.col("c.fetch_url")).alias("host")).first()
    if start.key is None:
        raise ValueError(f"not a URL of a page: {given['url']}")
    for pattern in [*scope["include"], *scope["exclude"]]:
        try:
            re.compile(pattern)
        except re.error as error:
            raise ValueError(f"not a pattern: {pattern} ({error})") from error
    scope["extra_domains"] = frozenset(d.lower().lstrip(".") for d in scope["extra_domains"])
    scope |= {k: tuple(scope[k]) for k in ("include", "exclude")}
    scope["backoff"] = max(0.0, scope["backoff"])
    fetcher["workers"] = max(1, fetcher["workers"])
    if fetcher["manual_login"]:  # a person needs one window that shows
        fetcher |= {"headless": False, "workers": 1}
    run["output"] = run["output"] or f"output/{start.host or 'site'}"
    if run["rewrite_only"]:
        run |= {"resume": True, "sitemap": False}
    return Run(start.fetch_url, start.key, Scope(start_host=start.host, **scope), fetcher=fetcher, **run)
