"""All queries of the reading-comparison operators with their SQL."""

from __future__ import annotations

from lectern.plans import coverage_queries, layout_queries, record_queries, run_queries, text_queries  # noqa: F401  they register theirs
from lectern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
