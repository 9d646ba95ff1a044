"""Exact deduplication by a tree merge of sorted digest runs.

Every document belongs to one of ``16 ** levels`` leaf runs, chosen by a hash of its
id and text.  A run holds one entry per distinct text: digest, smallest id, row count.
In each round sixteen sibling runs merge into their parent.  The parent is never one
task: its entries are exchanged by (run, digest), so partitions swap slices of their
runs as in a binomial tree, and Spark sorts both sides of the exchange and merges
equal digests (a sort aggregation, partial and final, as the smallest entry is a struct).

A text that a third of all rows share has at most one entry per leaf run after the
first round and a sixteenth of that after each further round.  On the way back the
winner of a digest is joined to its leaf entries and those to their own rows, so no
join key holds more than one leaf's share of a group.

An entry is verified at every level: digests merge only if the byte length and an
independent 64-bit hash of the text agree too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import SPACE, keep_rows, materialise, text_of

LEVELS = 3
#: What identifies a text: its digest, and the two values that verify it.
KEY = ["_digest", "_bytes", "_check"]


def normalised(text: Column) -> Column:
    """``text`` with each run of ASCII white space replaced by one space."""
    # single spaces stay as they are, so they need no replacing
    return F.regexp_replace(text, rf"[{SPACE}]{{2,}}|[\x09-\x0D]", " ")


def digests(docs: DataFrame, id_col: str, text_col: str, levels: int) -> DataFrame:
    """One row per document: _id, the key of its text and its leaf run."""
    norm = docs.select(F.col(id_col).alias("_id"), normalised(text_of(text_col)).alias("_norm"))
    keyed = norm.select("_id", F.unhex(F.sha2("_norm", 256)).alias("_digest"), F.octet_length("_norm").alias("_bytes"),
                        F.xxhash64("_norm").alias("_check"))
    return keyed.withColumn("_leaf", F.pmod(F.xxhash64("_id", "_check"), F.lit(16 ** levels)).cast("int"))


def merge_round(runs: DataFrame, run: Column) -> DataFrame:
    """Merge runs that get the same number ``run``; equal texts keep their smallest entry."""
    return (runs.withColumn("_run", run).groupBy("_run", *KEY)
            .agg(F.min("_best").alias("_best"), F.sum("_rows").alias("_rows")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after ``normalised``.  Null texts count as empty and so
    equal each other and the empty text.  Of equal texts the smallest id stays; a null id
    sorts last, so keep_id is null only if every id of the group is.  Of repeated rows
    (same id, same text) exactly one has kept = true.  An empty table gives an empty
    result; other columns of ``docs`` are not read.  Texts of any length are compared whole.
    """
    rows = materialise(digests(docs, id_col, text_col, levels))
    entry = F.struct(F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("id"), F.col("_leaf").alias("leaf"))
    leaves = merge_round(rows.select(*KEY, "_leaf", entry.alias("_best"), F.lit(1).alias("_rows")), F.col("_leaf"))
    runs = leaves
    for _ in range(levels):
        runs = merge_round(runs, F.shiftright("_run", 4))
    winners = runs.select(*KEY, F.col("_best.id").alias("keep_id"), F.col("_best.leaf").alias("_home"),
                          F.col("_rows").cast("long").alias("group_size"))
    placed = leaves.select(F.col("_run").alias("_leaf"), *KEY).join(winners, KEY)
    first = F.row_number().over(Window.partitionBy("_leaf", *KEY).orderBy(F.col("_id").asc_nulls_last())) == 1
    out = rows.withColumn("_first", first).join(placed, ["_leaf", *KEY])
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size",
                      (F.col("_first") & (F.col("_leaf") == F.col("_home"))).alias("kept"),
                      F.lower(F.hex("_digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = LEVELS) -> DataFrame:
    """``docs``, all columns, without the rows that ``exact_dedup`` drops.

    The cases of ``exact_dedup`` hold here too; of repeated rows with the smallest id, the
    one whose columns have the smallest hash stays.
    """
    stay = (exact_dedup(docs, id_col, text_col, levels).where("kept")
            .select(F.col(id_col).alias("_stay_id"), F.unhex("text_sha256").alias("_stay_key")))
    return keep_rows(docs, stay, id_col, F.unhex(F.sha2(normalised(text_of(text_col)), 256)))
