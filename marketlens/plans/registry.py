"""Registry of the data operators exposed through ``__spark_entry__``.

``(spark, sf_dir) -> DataFrame`` and, where the result is deterministic, to
an equivalent DuckDB SQL text over the driver's tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.sources import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key`` with its oracle SQL."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(catalog.load(spark, sf_dir))

        run.__name__ = f"q_{key}"
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return wrap


def load_all() -> None:
    """Import the modules that register queries."""
    from marketlens.plans import q_base, q_clean, q_explore, q_analysis, q_quality, q_insight, q_ingest, q_previews  # noqa: F401
