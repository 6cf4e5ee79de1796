"""How a module of queries collects them."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, SQL, decorator): the decorator registers a query under its name, with SQL if it has any."""
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
