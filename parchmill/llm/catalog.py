"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import conversations, encoding, leakage, neardup, packing, pairs, residue, splitting

_MODULES = (conversations, neardup, encoding, pairs, splitting, packing, leakage, residue)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
