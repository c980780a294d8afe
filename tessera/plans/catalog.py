"""All queries of the core, with their SQL."""

from __future__ import annotations

from . import graph_queries, rule_queries, table_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
