"""Imports every module that registers queries."""

from quoteflow.plans import book_queries, quality_queries, rule_queries, series_queries, signal_queries, source_queries, stream_queries  # noqa: F401
from quoteflow.plans import chunk_queries  # noqa: F401, I001 - after those whose SQL it shares
from quoteflow.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
