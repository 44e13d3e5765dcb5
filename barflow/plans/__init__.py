"""Registered queries: each operator on views of the driver's tables, with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: More views for the oracles, by name.
VIEWS: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its oracle's body."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def load_all() -> None:
    from . import data, evaluate, features, fusion, learning, rules, snapshots, streams  # noqa: F401


def oracle_sql() -> dict[str, str]:
    return {k: with_views(v, VIEWS) for k, v in ORACLES.items()}
