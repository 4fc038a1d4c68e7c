"""Query plans by name, and the SQL that states the same results."""

from __future__ import annotations

from skeinworks.plans import listings, listings_sql, records, state

MODULES = (records, listings, state)
SQL_MODULES = (records, listings_sql, state)


def queries() -> dict:
    """All queries of the core."""
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL twins of the core's queries."""
    return {k: s for m in SQL_MODULES for k, s in m.ORACLE_SQL.items()}
