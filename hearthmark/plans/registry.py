"""Query registry: each entry pairs a Spark query with SQL another engine can run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthmark.sources.tables import VIEWS, Tables, view_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared sub-queries of the oracle texts, by name.
SNIPPETS: dict[str, str] = {}


def snippet(name: str, sql: str) -> None:
    SNIPPETS[name] = sql


def _uses(text: str) -> list[str]:
    known = [*VIEWS, *SNIPPETS]
    return [n for n in known if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)]


def with_views(body: str) -> str:
    """Put the texts of all market tables and snippets the body reads in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _uses(_text(name)):
            if dep != name:
                visit(dep)
        order.append(name)

    for n in _uses(body):
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({_text(n)})" for n in order)
    return f"WITH {ctes}\nSELECT * FROM ({body}) AS q"


def _text(name: str) -> str:
    return SNIPPETS[name] if name in SNIPPETS else view_text(name, "duckdb")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is its oracle."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql)
        return fn
    return wrap
