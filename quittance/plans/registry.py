"""All receipt queries by name."""

from __future__ import annotations

from quittance.plans import documents_sql, drawn, measures, receipts, services

_MODULES = (receipts, measures, services, drawn, documents_sql)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
