"""Queries of the core operators and the SQL that checks them."""

from __future__ import annotations

from . import chats, chunks, pages, search

_MODULES = (pages, chunks, chats, search)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
