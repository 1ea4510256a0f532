"""The library's queries and their DuckDB equivalents, by name."""

from __future__ import annotations

from .plans import catalogue, documents, search, sites, sources, traffic  # noqa: F401  each registers its queries
from .plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "ev_quality_report"
