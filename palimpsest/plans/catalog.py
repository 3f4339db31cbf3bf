"""All queries of the core and their DuckDB statements."""

from __future__ import annotations

from palimpsest.plans import found, found_sql, ledgers, listings, projections, retrieval, sourced, surface, temporal, texts

_REGISTERS = [temporal.register, projections.register, texts.register, retrieval.register, ledgers.register, listings.register, sourced.register, surface.register]

QUERIES = dict(found.QUERIES)
SQL = dict(found_sql.SQL)
for _register in _REGISTERS:
    QUERIES |= _register.queries
    SQL |= _register.sql
