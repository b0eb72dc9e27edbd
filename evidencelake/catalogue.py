"""All queries of the evidence operators, by name, and their SQL."""

from __future__ import annotations

from evidencelake.plans import case, casework, content, files, ranges, times  # noqa: F401  (they register)
from evidencelake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
