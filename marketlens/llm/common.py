"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.session import ensure_checkpoint_dir

#: The six ASCII white-space characters that separate words, for use in a regex class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: The same characters as text.
SPACE_CHARS = " \t\n\x0b\x0c\r"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 256


def slices(values, step: int = SLICE) -> Iterator[list]:
    """The values of an Arrow array as lists of ``step``, so that a batch is never held twice."""
    for at in range(0, len(values), step):
        yield values.slice(at, step).to_pylist()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written files.

    Later jobs, and tasks that are run again after an executor is lost, read the
    files instead of repeating the work.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(name: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words of ``text``; an empty array if it has none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{SPACE}]+"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


#: Items of an array that are gone through together.
BLOCK = 256
#: Code points of text around a match that are its context.
CONTEXT = 80


def scan(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Array of the outputs (of type ``kind``) of ``step`` from state and item to the next state and an output.

    Outputs are put together in blocks, so the work stays in proportion to the array.
    """
    def one(a: Column, x: Column) -> Column:
        then, out = step(a["state"], x)
        return F.struct(then.alias("state"), F.concat(a["out"], F.array(out)).alias("out"))

    def through(xs: Column) -> Column:
        def block(a: Column, b: Column) -> Column:
            zero = F.struct(a["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
            done = F.aggregate(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)), zero, one)
            return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(a["out"], F.array(d["out"])).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(xs) == 0, F.array().cast(f"array<{kind}>")).otherwise(F.flatten(F.aggregate(blocks, start, block)["out"]))

    return let(items, through)


def match_places(text: Column, pattern, width: Callable[[Column], Column] = F.char_length, context: bool = False) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, and with ``context`` (before, after).

    Places count in ``width``, code points by default.  before and after are the up to
    CONTEXT code points of the text next to the match, whatever other matches they hold.
    """
    def forward(s: Column, x: Column) -> tuple[Column, Column]:
        start = s["at"] + width(x["gap"])
        end = start + width(x["hit"])
        place = [start.alias("start"), end.alias("end"), x["hit"].alias("value")]
        if not context:
            return F.struct(end.alias("at")), F.struct(*place)
        before = F.right(F.concat(s["tail"], x["gap"]), F.lit(CONTEXT))
        return F.struct(end.alias("at"), F.right(F.concat(before, x["hit"]), F.lit(CONTEXT)).alias("tail")), F.struct(*place, before.alias("before"))

    def backward(head: Column, x: Column) -> tuple[Column, Column]:
        after = F.left(F.concat(x["next"], head), F.lit(CONTEXT))
        return F.left(F.concat(x["hit"], after), F.lit(CONTEXT)), after

    def places(hits: Column, pieces: Column) -> Column:
        # the gap before a match, the match, and the gap after it
        rows = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("gap"), hits.alias("hit"), F.slice(pieces, 2, F.size(hits)).alias("next"))
        kind = "struct<start:int,end:int,value:string>"
        if not context:
            return scan(rows, F.struct(F.lit(0).alias("at")), kind, forward)
        kind = kind[:-1] + ",before:string>"
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
        return let(rows, lambda xs: let(F.reverse(scan(F.reverse(xs), F.lit(""), "string", backward)), lambda afters: F.transform(
            scan(xs, zero, kind, forward), lambda x, i: F.struct(x["start"], x["end"], x["value"], x["before"], F.get(afters, i).alias("after")))))

    none = "array<struct<start:int,end:int,value:string" + (",before:string,after:string>>" if context else ">>")
    return let(F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)), lambda hits: F.when(
        F.size(hits) == 0, F.array().cast(none)).otherwise(let(F.split(text, pattern, -1), lambda pieces: places(hits, pieces))))


def join_spread(rows: DataFrame, table: DataFrame, key: str, spread: Column, leaves: int | None = None) -> DataFrame:
    """``rows`` joined to ``table`` (one row per ``key``), also if a third of the rows have one key.

    The rows of a key are dealt to leaves, as many as there are shuffle partitions and 64 at
    least, so a hot key is spread as widely as the cluster is.  The table is joined to the
    distinct (key, leaf) pairs, which map-side aggregation makes few, and those to the rows.
    """
    leaves = leaves or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_leaf", F.pmod(spread, F.lit(leaves)).cast("int"))
    pairs = dealt.select(key, "_leaf").distinct().join(table, key)
    return dealt.join(pairs, [key, "_leaf"]).drop("_leaf")


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str,
                total: str | None = None, kind: str = "long") -> DataFrame:
    """Sum of ``value`` over the rows of the same ``group`` that come before the row, as ``kind``,
    in the order (``bucket``, ``order``...); ``total`` names a column for the sum of the group.

    Three levels keep every window small: rows within a bucket, buckets within a run
    of 1,024 buckets, and runs within the group.  A group that holds a third of all rows
    is spread over its buckets.  The caller chooses buckets of a bounded number of rows.
    """
    runs = F.floor(F.col(bucket) / 1024)
    before = (Window.unboundedPreceding, -1)
    by_bucket = df.groupBy(*group, bucket).agg(F.sum(value).alias("_n")).withColumn("_run", runs)
    in_run = F.coalesce(F.sum("_n").over(Window.partitionBy(*group, "_run").orderBy(bucket).rowsBetween(*before)), F.lit(0))
    by_bucket = by_bucket.withColumn("_in_run", in_run)
    by_run = by_bucket.groupBy(*group, "_run").agg(F.sum("_n").alias("_run_n"))
    run_at = F.coalesce(F.sum("_run_n").over(Window.partitionBy(*group).orderBy("_run").rowsBetween(*before)), F.lit(0))
    by_run = by_run.withColumn("_run_at", run_at).withColumn("_all", F.sum("_run_n").over(Window.partitionBy(*group)))
    starts = by_bucket.alias("b").join(by_run.alias("r"), [F.col(f"b.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_run"]])
    starts = starts.select(*[F.col(f"b.{c}").alias(f"_s{i}") for i, c in enumerate([*group, bucket])],
                           (F.col("_run_at") + F.col("_in_run")).alias("_begin"), F.col("_all"))
    w = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(*before)
    rows = df.withColumn("_before", F.coalesce(F.sum(value).over(w), F.lit(0)))
    on = [rows[c].eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate([*group, bucket])]
    placed = rows.join(starts, on)
    sums = [(F.col("_begin") + F.col("_before")).cast(kind).alias(out)] + ([F.col("_all").alias(total)] if total else [])
    return placed.select(*df.columns, *sums)


def keep_rows(docs: DataFrame, stay: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Rows of ``docs``, all columns, whose id and ``key`` are in ``stay`` (_stay_id, _stay_key).

    Of repeated rows (same id, same key) one stays: the one whose columns, all together, have
    the smallest hash, so reruns agree.  Ids are compared null-safe.  Whole rows are shuffled
    once, to be joined; how often an id and key occur is counted on those two alone, and
    only rows that are repeated are compared.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    keyed = docs.select(row, F.col(id_col).alias("_id"), key.alias("_key"))
    times = keyed.groupBy("_id", "_key").agg(F.count("*").alias("_times"))
    wanted = stay.select("_stay_id", "_stay_key").distinct()
    same = F.col("_id").eqNullSafe(F.col("_stay_id")) & (F.col("_key") == F.col("_stay_key"))
    wanted = materialise(wanted.join(times, same).select("_stay_id", "_stay_key", "_times"))
    found = keyed.join(wanted, same)
    repeated = found.where("_times > 1").groupBy("_id", "_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return found.where("_times = 1").select("_row.*").unionByName(repeated.select("_row.*"))


def connected(edges: DataFrame, materialise_round: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star rounds until the edges no longer change.  Every
    round is written to the checkpoint folder; the driver sees one count and one checksum.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialise_round(pairs)
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("_low")).select(F.col("a").alias("_a"), F.least("a", "_low").alias("_low"))
        # a node can be the neighbour of very many
        large = join_spread(both.where("b > a"), lowest.withColumnRenamed("_a", "a"), "a", F.xxhash64("b")).select(F.col("b").alias("a"), F.col("_low").alias("b"))
        large = large.unionByName(lowest.where("_a > _low").select(F.col("_a").alias("a"), F.col("_low").alias("b"))).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("_low")).withColumnRenamed("a", "_a")
        small = join_spread(large, lowest.withColumnRenamed("_a", "a"), "a", F.xxhash64("b")).where("b <> _low").select(F.col("b").alias("a"), F.col("_low").alias("b"))
        pairs = materialise_round(small.unionByName(lowest.select(F.col("_a").alias("a"), F.col("_low").alias("b"))).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
