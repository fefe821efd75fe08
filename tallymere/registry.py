"""The queries of the listing engine and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from .plans import record_queries, run_queries, scalar_queries, scan_queries, store_queries  # noqa: F401
from .plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
