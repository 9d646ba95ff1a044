"""

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task
(``Exchange SinglePartition``).  Here Spark deals the rows to ranges of the wanted order
with ``repartitionByRange`` and sorts each range; a row's place is the number of rows in
the ranges before its own plus its place in its range.  The number of ranges follows the
number of rows, ``ROWS_PER_RANGE`` each, at every size.  If all rows make one range there is
nothing to deal: one task would sort them in any case, so they are numbered by a window.

The sorted ranges are written to the checkpoint folder: their boundaries come from a sample
that Spark takes anew each time, so a plan that is run twice would otherwise cut the ranges
in two ways.  A single range has no boundaries and needs no such file.  What is known of the
ranges (one row for each) is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000_000
#: monotonically_increasing_id holds the partition above, and the row below this bit.
_ROW_BITS = 33

Order = list[tuple[str, bool]]


def _sort_cols(order: Order) -> list[Column]:
    """NULL sorts lowest: first when ascending, last when descending."""
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order]


def ranges_of(df: DataFrame, rows_per_range: int | None = None) -> int:
    """The number of ranges that the rows make."""
    return max(1, -(-df.count() // (rows_per_range or ROWS_PER_RANGE)))


def in_ranges(df: DataFrame, order: Order, rows_per_range: int | None = None, n: int | None = None) -> DataFrame:
    """``df`` sorted into ranges, with __range and __nth, the row's place in its range from 0.

    ``n`` is the number of ranges if it is known.
    """
    n = n or ranges_of(df, rows_per_range)
    cols = _sort_cols(order)
    if n == 1:
        place = F.row_number().over(Window.orderBy(*cols)) - 1
        return df.withColumns({"__range": F.lit(0).cast("long"), "__nth": place.cast("long")})
    dealt = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    rows = stable(dealt.withColumn("__id", F.monotonically_increasing_id()))
    return (rows.withColumn("__range", F.shiftright("__id", _ROW_BITS))
            .withColumn("__nth", F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("__id"))


def _before(rows: DataFrame, amount: Column) -> DataFrame:
    """(__r, __before, __all): the sum of ``amount`` in the ranges before each range, and over all."""
    by_range = rows.groupBy(F.col("__range").alias("__r")).agg(amount.alias("__n"))
    w = Window.orderBy("__r")  # over ranges, not rows
    return by_range.select("__r", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
                           F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))


def _offset(rows: DataFrame, amount: Column) -> DataFrame:
    return rows.join(F.broadcast(_before(rows, amount)), F.col("__range") == F.col("__r")).drop("__r")


def global_ntile(df: DataFrame, n: int, order: Order, id_col: str, out: str, rows_per_range: int | None = None, ranges: int | None = None) -> DataFrame:
    """NTILE(n) OVER (ORDER BY order..., id_col) without a single-partition window.

    ``order`` is a list of (column, ascending).  The id breaks ties (R13), so
    the result is deterministic.  First ``N mod n`` buckets get one extra row.
    """
    if n <= 0:
        raise ValueError("ntile needs n > 0")
    ranges = ranges or ranges_of(df, rows_per_range)
    if ranges == 1:
        return df.withColumn(out, F.ntile(n).over(Window.orderBy(*_sort_cols([*order, (id_col, True)]))).cast("int"))
    placed = _offset(in_ranges(df, [*order, (id_col, True)], rows_per_range, ranges), F.count("*"))
    pos, base, big = F.col("__before") + F.col("__nth"), F.expr(f"__all div {n}"), F.col("__all") % n
    cut = big * (base + 1)
    in_small = big + F.floor((pos - cut) / F.nullif(base, F.lit(0))) + 1
    bucket = F.when(pos < cut, F.floor(pos / (base + 1)) + 1).otherwise(in_small)
    return placed.withColumn(out, bucket.cast("int")).select(*df.columns, out)


def global_ntiles(df: DataFrame, specs: list[tuple[int, Order, str]], id_col: str, rows_per_range: int | None = None) -> DataFrame:
    """Several NTILEs over the same rows, counted once; ``specs`` holds (n, order, output column)."""
    ranges = ranges_of(df, rows_per_range)
    for n, order, out in specs:
        df = global_ntile(df, n, order, id_col, out, rows_per_range, ranges)
    return df


def global_rank(df: DataFrame, order: Order, out: str, partition_by: list[str] | None = None, rows_per_range: int | None = None) -> DataFrame:
    """RANK() OVER ([PARTITION BY p] ORDER BY order...) over distinct key tuples.

    Keys are grouped first (a hot key becomes one weighted row), ranked by prefix sums of
    their weights, and joined back on the key.  With ``partition_by`` the rank is taken over
    (p, order...) and shifted by the rank of the partition's first row, so one large
    partition is still spread over many tasks.
    """
    leading = [(c, True) for c in partition_by or []]
    if ranges_of(df, rows_per_range) == 1:
        w = Window.partitionBy(*partition_by) if partition_by else Window
        return df.withColumn(out, F.rank().over(w.orderBy(*_sort_cols(order))).cast("int"))
    names = [c for c, _ in [*leading, *order]]
    keys = in_ranges(df.groupBy(*names).agg(F.count("*").alias("__w")), [*leading, *order], rows_per_range)
    w = Window.partitionBy("__range").orderBy("__nth").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _offset(keys.withColumn("__here", F.coalesce(F.sum("__w").over(w), F.lit(0))), F.sum("__w"))
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__here") + 1)
    if partition_by:
        firsts = ranked.groupBy(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(partition_by)]).agg(F.min("__rank").alias("__first"))
        same = [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(partition_by)]
        ranked = ranked.join(firsts, same).withColumn("__rank", F.col("__rank") - F.col("__first") + 1)
    ranked = ranked.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(names)], F.col("__rank").cast("int").alias(out))
    return df.join(ranked, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)]).select(*df.columns, out)


def stable(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared folder, so that a lost
    executor does not force the whole upstream plan to be computed again."""
    if not enabled:
        return df
    from marketlens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running_sum(df: DataFrame, partition_by: list[str], order: Order, value: str, out: str, rows_per_range: int | None = None,
                ranges: int | None = None) -> DataFrame:
    """SUM(value) OVER (PARTITION BY p ORDER BY order ROWS UNBOUNDED PRECEDING).

    ``order`` must make rows unique within a partition.  Each range of (p, order...) runs
    its own sum; a partition that goes on from earlier ranges adds the sum of its rows
    there.  Only partitions that lie across a boundary need that, at most one for each
    boundary, so their sums are broadcast.  As with the window, the sum is NULL until the
    first value that is not.
    """
    ranges = ranges or ranges_of(df, rows_per_range)
    if ranges == 1:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*partition_by).orderBy(*_sort_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = in_ranges(df, [*[(c, True) for c in partition_by], *order], rows_per_range, ranges)
    w = Window.partitionBy("__range", *partition_by).orderBy("__nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("__local", F.sum(value).over(w))
    by_part = rows.groupBy("__range", *partition_by).agg(F.sum(value).alias("__t"))
    within = Window.partitionBy(*partition_by)
    earlier = within.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.withColumn("__off", F.sum("__t").over(earlier)).where("__off is not null").select(
        F.col("__range").alias("__r"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(partition_by)], "__off")
    same = [F.col("__range") == F.col("__r")] + [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(partition_by)]
    joined = local.join(F.broadcast(offsets), same, "left")
    total = F.when(F.col("__off").isNull(), F.col("__local")).otherwise(F.coalesce("__local", F.lit(0)) + F.col("__off"))
    kind = local.schema["__local"].dataType
    return joined.withColumn(out, total.cast(kind)).select(*df.columns, out)


__all__ = ["global_ntile", "global_ntiles", "global_rank", "in_ranges", "ranges_of", "running_sum", "stable"]
