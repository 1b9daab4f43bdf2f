"""What a crawl covers, and its limits."""

from __future__ import annotations

from dataclasses import dataclass, field

from webloom.functions import fixed


@dataclass(frozen=True)
class Scope:
    """Settings of a crawl, with limits brought into range.

    ``start_host`` is allowed in any case; ``extra_domains`` are allowed exactly, and their subdomains
    with ``include_subdomains``.
    """

    start_host: str = ""
    allowed_hosts: frozenset[str] = frozenset()
    extra_domains: frozenset[str] = frozenset()
    include_subdomains: bool = False
    path_prefix: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    keep_query: bool = True
    crawl_iframes: bool = True
    max_depth: int = 3
    max_pages: int = 300
    max_retries: int = 2
    backoff: float = 5.0
    delay: float = 0.4
    max_asset_mb: float = 25.0
    css_depth: int = 4
    strict_depth: bool = True

    def __post_init__(self) -> None:
        hosts = {h.lower() for h in (self.start_host, *self.allowed_hosts, *self.extra_domains) if h}
        put = lambda k, v: object.__setattr__(self, k, v)
        put("allowed_hosts", frozenset(hosts))
        for k in ("max_depth", "max_pages", "max_retries"):
            put(k, max(0, getattr(self, k)))

    @property
    def max_asset_bytes(self) -> int:
        return int(self.max_asset_mb * 1024 * 1024)

    def start_domain(self) -> str:
        parts = self.start_host.lower().split(".")
        keep = 3 if len(parts) > 2 and parts[-2] in fixed.SECOND_LEVEL and len(parts[-1]) <= 3 else 2
        return ".".join(parts[-keep:])
