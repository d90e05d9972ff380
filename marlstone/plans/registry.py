"""Every registered query: its Spark form and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add
