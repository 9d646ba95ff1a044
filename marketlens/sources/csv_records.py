"""Logical records of CSV files whose quoted text holds line breaks, read in splits.

Spark's ``multiLine`` makes each file one task, as a reader that starts in the middle of a
file cannot know whether it is inside quotes.  Here files are read as lines, split by Spark
as usual, in two passes.  The first finds for each split whether its end is inside quotes
if its start is, and if its start is not.  These effects are put together along the file
with window sums over one row per split, which gives the state in which each split really
starts.  The second pass puts the lines of a record together.  A record that goes on in
another split comes in fragments, and only those are shuffled.

A quote opens a field only at its beginning; a quote elsewhere in a field without quotes is
a character like any other and does not change what the rest of the file means.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: From inside quotes to the quote that ends the field; doubled quotes stay inside.
TO_CLOSING = re.compile(r'(?:[^"]|"")*+"')
#: Kinds of pieces: a whole record, the end of a record from before, one in its middle, the beginning of one that goes on.
WHOLE, HEAD, MIDDLE, TAIL = range(4)


def open_after(line: str, inside: bool) -> bool:
    """Whether the end of ``line`` is inside quotes."""
    at, quoted = 0, inside
    while True:
        if quoted:
            closing = TO_CLOSING.match(line, at)
            if not closing:
                return True
            at = closing.end()
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1
        quoted = line.startswith('"', at)
        at += quoted


def after(line: str, inside: bool) -> bool:
    """``open_after`` for a line as it stands: without quotes nothing changes, outside quotes it begins a field."""
    if '"' not in line:
        return inside
    if not inside and line.startswith('"'):
        return open_after(line[1:], True)
    return open_after(line, inside)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): every line with a hash of its file and the place where its split starts."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """((file, start), from, to) of the lines of each split in the batch."""
    file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
    change = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *change.tolist()], [*change.tolist(), len(file)]):
        if b > a:
            yield (int(file[a]), int(start[a])), a, b


def quoted_lines(values: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))


def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split and batch: its order in the task, and whether it ends inside quotes from either state."""
    nth = 0
    for batch in batches:
        values = batch.column("value")
        with_quotes = quoted_lines(values)
        for (file, start), a, b in runs(batch):
            states = [False, True]
            for i in with_quotes[np.searchsorted(with_quotes, a):np.searchsorted(with_quotes, b)].tolist():
                line = values[i].as_py()
                states = [after(line, s) for s in states]
            yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "nth": [nth], "from_outside": [states[0]], "from_inside": [states[1]]})
            nth += 1


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside, open): the states in which each split starts and ends.

    A part of a split sets the state (both its ends are alike), swaps it, or leaves it.  The
    state is what the last part that set it says, swapped as often as parts since then say.
    """
    parts = lines.mapInArrow(effects, "file long, start long, nth long, from_outside boolean, from_inside boolean")
    order = Window.partitionBy("file").orderBy("start", "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("from_outside") == F.col("from_inside")
    swaps = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    parts = parts.withColumn("n", F.coalesce(F.sum(swaps).over(before), F.lit(0)))
    last = F.last(F.when(sets, F.struct(F.col("from_outside").alias("value"), "n")), ignorenulls=True).over(before)
    odd = (F.col("n") - F.coalesce("last.n", F.lit(0))) % 2 == 1
    states = parts.withColumn("last", last).withColumn("inside", F.coalesce("last.value", F.lit(False)) != odd)
    end = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    return states.groupBy("file", "start").agg(F.min_by("inside", "nth").alias("inside"), F.max_by(end, "nth").alias("open"))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and fragments of those that go over the ends of splits."""
    now, inside, kept, head = None, False, [], False

    def out(values: pa.Array, kind: int, header: bool = False) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([pa.repeat(now[0], n), pa.repeat(now[1], n), pa.repeat(pa.scalar(kind, pa.int32()), n), pa.array([header] + [False] * (n - 1)), values],
                                          ["file", "start", "kind", "first", "record"])

    def fragment(kind: int) -> pa.RecordBatch:
        return out(pa.array(["\n".join(kept)], pa.string()), kind, now[1] == 0 and not seen)

    for batch in batches:
        values = batch.column("value")
        with_quotes = quoted_lines(values)
        states = batch.column("inside")
        for key, a, b in runs(batch):
            if key != now:
                if now and inside:
                    yield fragment(MIDDLE if head else TAIL)
                now, inside, kept, seen = key, states[a].as_py(), [], False
                head = inside
            whole: list[pa.Array] = []  # in the order of the file
            at = a
            for i in with_quotes[np.searchsorted(with_quotes, a):np.searchsorted(with_quotes, b)].tolist():
                line = values[i].as_py()
                was, inside = inside, after(line, inside)
                if not was and inside:
                    whole.append(values.slice(at, i - at))
                    kept, at = [line], i + 1
                elif was and not inside:
                    kept += [*values.slice(at, i - at).to_pylist(), line]
                    at = i + 1
                    if head:
                        yield fragment(HEAD)
                        head, seen = False, True
                    else:
                        whole.append(pa.array(["\n".join(kept)], pa.string()))
            if inside:
                kept += values.slice(at, b - at).to_pylist()
            else:
                whole.append(values.slice(at, b - at))
            together = pa.concat_arrays(whole) if whole else values.slice(0, 0)
            if len(together):
                yield out(together, WHOLE, now[1] == 0 and not seen)
                seen = True
    if now and inside:
        yield fragment(MIDDLE if head else TAIL)


def without_return(record: Column) -> Column:
    """``record`` without the carriage return of its line break; a pattern is matched only where there is one."""
    return F.when(record.contains("\r"), F.regexp_replace(record, "\r$", "")).otherwise(record)


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines as records, the first of each file marked."""
    now = None
    for batch in batches:
        first = np.zeros(batch.num_rows, bool)
        for key, a, _ in runs(batch):
            first[a] = key != now and key[1] == 0
            now = key
        yield pa.RecordBatch.from_arrays([pa.array(first), batch.column("value")], ["first", "record"])


def records(spark: SparkSession, path: str, breaks: bool = True) -> DataFrame:
    """(first, closed, record): every record of the CSV files at ``path``; empty lines are none.

    ``first`` marks the first record of a file, ``closed`` is false for a record whose quotes
    are still open at the end of its file.  Without ``breaks`` every line is a record.
    """
    lines = lines_of(spark, path)
    if not breaks:
        found = lines.mapInArrow(marked, "first boolean, record string").select("first", F.lit(True).alias("closed"), "record")
        return found.withColumn("record", without_return(F.col("record"))).where("record <> ''")
    # one row per split of a file, some million for a petabyte
    states = split_states(lines)

    def found(states: DataFrame) -> DataFrame:
        rows = lines.join(F.broadcast(states), ["file", "start"]).select("file", "start", "value", "inside")
        return rows.mapInArrow(pieces, "file long, start long, kind int, first boolean, record string")

    whole = found(states).where(F.col("kind") == WHOLE).select("first", F.lit(True).alias("closed"), "record")
    order = Window.partitionBy("file").orderBy("start", "kind")
    number = F.sum((F.col("kind") == TAIL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # only splits that start or end inside quotes have fragments
    parts = found(states.where("inside or open")).where(F.col("kind") != WHOLE).withColumn("number", number)
    joined = parts.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("all"), F.max("first").alias("first"),
                                                 F.max((F.col("kind") == HEAD).cast("int")).alias("closed"))
    joined = joined.select("first", (F.col("closed") == 1).alias("closed"), F.array_join("all.record", "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", without_return(F.col("record"))).where("record <> ''")
