"""Registered queries and the SQL that gives the same results."""

from tessella.plans import labels, pixels, runs, scores, tiled  # noqa: F401  they register their queries
from tessella.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
