"""All queries of the library proper, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a (spark, folder) function under its name, with SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from textloom.plans import analytics, called, compounds, configured, documents, entity_quality, facts, foods, groups, knowledge, language, measures, merging, questions, relational, structure, tables, texts  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
