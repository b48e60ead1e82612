"""All queries of the engine itself, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import catalog, roundtrips  # noqa: F401  registers its queries


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(ship(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shipped(f) for k, f in catalog.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
