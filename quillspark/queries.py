"""All queries of the library by name, with their oracle SQL."""

from __future__ import annotations

from quillspark.plans import case_queries, file_queries  # noqa: F401  they register their queries
from quillspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
