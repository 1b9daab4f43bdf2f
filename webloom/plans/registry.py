"""Queries by name, and the same in DuckDB SQL."""

from webloom.plans import crawl_plans, deep_plans, literal_plans, markup_plans, mirror_plans, page_plans, site_plans, stream_plans  # noqa: F401
from webloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
