"""Training-data operators and their queries."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
