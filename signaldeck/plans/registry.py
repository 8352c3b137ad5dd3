"""Registry of the named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *ctes: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` is its oracle over the driver tables, after ``ctes``."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return fn

    return register


def uuid5_sql(namespace: str, text: str) -> str:
    """Oracle form of :func:`signaldeck.functions.ids.uuid5`."""
    digest = f"sha1(unhex('{namespace}') || encode({text}))"
    return (
        f"substr({digest}, 1, 12) || '5' || substr({digest}, 14, 3) || "
        f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || "
        f"substr({digest}, 18, 15)"
    )
