"""Registered queries of the library and the SQL each is checked against."""

from __future__ import annotations

from .plans import q_built, q_columns, q_domain, q_integrity, q_learning, q_levels, q_risk, q_small, q_tables, q_user  # noqa: F401  (they register their queries)
from .plans.pairs import ORACLE_SQL, QUERIES

flagship = q_tables.flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
