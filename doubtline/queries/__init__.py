"""Registered queries over the test tables, with a DuckDB statement where SQL can say the same."""

from doubtline.queries.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
