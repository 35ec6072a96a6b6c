"""Registered queries over the driver's tables, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from .plans import cohort_queries, model_queries, study_queries  # noqa: F401  they register
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
