"""All queries over the engine's own operators, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "composite_ranking"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its DuckDB SQL if there is one."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _load() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(f"quarrymill.plans.{module}")


MODULES = ("q_text", "q_rows", "q_joins", "q_aggs", "q_windows", "q_scores", "q_graph", "q_search", "q_checks", "q_sources")


def queries() -> dict[str, Query]:
    """By name: what takes (spark, sf_dir) and returns a DataFrame."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """By name: DuckDB SQL with the same rows."""
    _load()
    return dict(_SQL)
