"""The registered queries and their SQL for DuckDB."""

from __future__ import annotations

from . import changes, costs, curation, display, entities, extraction, extras, graph, indexes, landed, pages, quality, records, related, review, rules, search, text, versions

_PLANS = (text, search, related, indexes, extraction, records, review, versions, entities, display, pages, landed, graph, quality, costs, changes, curation, rules, extras)


def queries() -> dict:
    return {name: f for plan in _PLANS for name, f in plan.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
