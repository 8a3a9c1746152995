"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict[str, str], Callable]:
    """Queries by name, their SQL by name, and a decorator query(name, sql) that adds to both."""
    queries: dict = {}
    sql_of: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def register(f):
            queries[name] = f
            if sql:
                sql_of[name] = sql
            return f

        return register

    return queries, sql_of, query
