"""Partitions whose number follows the number of rows.

A shuffle has ``spark.sql.shuffle.partitions`` partitions, however many rows there are, so a
task of an aggregation by a fine key holds more groups the larger the tables are.  Rows dealt
with ``dealt`` make tasks of about ``ROWS_PER_TASK`` rows at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS_PER_TASK = 100_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of at most about ``rows`` rows, hash partitioned by ``keys``."""
    return df.repartition(max(1, -(-rows // ROWS_PER_TASK)), *keys)
