"""Unordered item pairs that occur together in the same group (basket).

``pair_counts`` counts, for every pair ``a < b``, the groups that hold both.
A plain self-join on the group key sends every pair of a basket to the one
task that owns the basket, so a basket holding a third of all rows would
put quadratic work on a single task.  Here a basket larger than ``chunk``
items is split into ``m = ceil(size / chunk)`` hash chunks, and every pair
of chunks ``(lo, hi)`` becomes its own join key ``(group, lo, hi)``:

- side A holds the items of chunk ``lo`` under keys ``(g, lo, hi)`` for all
  ``hi >= lo``; side B the items of chunk ``hi`` under ``(g, lo, hi)`` for
  all ``lo <= hi``;
- keys with ``lo < hi`` join every item of one chunk with every item of the
  other; keys with ``lo == hi`` keep ``a < b`` within the chunk;
- so each unordered pair of the basket is produced exactly once, by one of
  ``m (m + 1) / 2`` keys with about ``chunk ** 2`` pairs each.

Each item of a split basket is replicated ``m + 1`` times; baskets at or
below ``chunk`` items are not replicated and join exactly like the plain
self-join.  Basket sizes are partial-aggregated map side.  The list of
split baskets (normally empty or tiny) is joined back without an eager
driver-side count: AQE measures it at runtime and broadcasts it when small;
otherwise both sides are clustered by the group key (no extra exchange on
tables bucketed by it), and AQE's skew handling splits a hot partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Items per chunk of a split basket: a join key then yields at most about
# DEFAULT_CHUNK ** 2 / 2 candidate pairs.
DEFAULT_CHUNK = 2048


def chunked_basket(df: DataFrame, group: str, item: str, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Distinct (group, item) rows with ``__ch`` (chunk) and ``__m`` (chunks in the basket)."""
    kept = df.select(group, item).where(F.col(group).isNotNull() & F.col(item).isNotNull())
    gi = kept.distinct()
    # Sizes count raw rows: duplicates can only raise m, which keeps the
    # result exact (any m >= 1 is) and saves a distinct.
    hot = (kept.groupBy(group).agg(F.count("*").alias("__n"))
           .where(F.col("__n") > chunk)
           .select(group, F.ceil(F.col("__n") / F.lit(chunk)).cast("int").alias("__m")))
    m = F.coalesce(F.col("__m"), F.lit(1))
    return (gi.join(hot, group, "left")
            .select(group, item, m.alias("__m"),
                    F.pmod(F.xxhash64(item), m).cast("int").alias("__ch")))


def pair_counts(df: DataFrame, group: str, item: str, a: str, b: str, out: str,
                chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """(a, b, out): number of groups holding both items, for every pair ``a < b``."""
    cb = chunked_basket(df, group, item, chunk)
    later = F.sequence(F.col("__ch"), F.col("__m") - 1)  # hi >= own chunk
    earlier = F.sequence(F.lit(0), F.col("__ch"))          # lo <= own chunk
    left = cb.select(group, F.col(item).alias("__a"), F.col("__ch").alias("__lo"),
                     F.explode(later).alias("__hi"))
    right = cb.select(group, F.col(item).alias("__b"), F.explode(earlier).alias("__lo"),
                      F.col("__ch").alias("__hi"))
    same_chunk = F.col("__lo") == F.col("__hi")
    joined = (left.join(right, [group, "__lo", "__hi"])
              .where(~same_chunk | (F.col("__a") < F.col("__b"))))
    return (joined.select(F.least("__a", "__b").alias(a), F.greatest("__a", "__b").alias(b))
            .groupBy(a, b).agg(F.count("*").alias(out)))


__all__ = ["DEFAULT_CHUNK", "chunked_basket", "pair_counts"]
