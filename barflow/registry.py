"""Queries of the market time-series operators and the SQL of the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans.load_all()
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    plans.load_all()
    return plans.oracle_sql()
