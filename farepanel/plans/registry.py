"""Registry of queries and of the DuckDB text each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from farepanel.sources.panel import Panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Named CTE available to every oracle; later views may use earlier ones."""
    if VIEWS.setdefault(name, sql.strip()) != sql.strip():
        raise ValueError(f"view {name} defined twice")


def expand(sql: str) -> str:
    """Prepend the CTEs that the text uses, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in VIEWS if name in needed)
    if not ctes:
        return sql.strip()
    text = sql.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"


def query(name: str, sql: str | None = None):
    """Register ``fn(panel) -> DataFrame`` under a key, with its oracle text."""

    def register(fn: Callable[[Panel], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Panel(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = expand(sql)
        return fn

    return register
