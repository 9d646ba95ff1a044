"""Bronze (raw text) layer: CSV ingest and a dirty text rendering of silver.

The raw tables are read with an all-string schema (never inferred).  Records that do not
fit the schema are set aside as rejects.  Review text contains quoted line breaks; its files
are read in splits all the same (``csv_records``).
``render_dirty`` turns typed rows back into the kind of text the cleaning
step must handle (padding blanks, empty strings for NULL, zip codes without
leading zeros, date-only midnights) so cleaning is exercised end to end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.sources import csv_records, schemas
from marketlens.sources.catalog import Tables

ZIP_COLUMNS = {"customer_zip_code_prefix", "seller_zip_code_prefix", "geolocation_zip_code_prefix"}


#: Tables whose quoted text may hold line breaks.
BREAKS = {"order_reviews"}
OPTIONS = {"quote": '"', "escape": '"'}
CORRUPT = "_corrupt_record"


class Ingested(NamedTuple):
    """The rows of a raw table, its rejects: (first_field, reason, raw_record), and both in one frame.

    ``judged`` has the fields of every record and raw_record, which is NULL for those that fit.
    """

    rows: DataFrame
    rejects: DataFrame
    judged: DataFrame


def _parsed(spark: SparkSession, table: str, path: str, breaks: bool) -> DataFrame:
    """Every record with its fields, _corrupt_record if their number is wrong, and _open if its quotes are."""
    names = schemas.columns(table)
    schema = ", ".join(f"{n} string" for n in [*names, CORRUPT])
    row = F.from_csv(F.col("record"), schema, {**OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    header = F.array(*[F.regexp_replace(F.coalesce(F.col(n), F.lit("")), "^\ufeff", "") for n in names])
    wrong = F.raise_error(F.concat(F.lit(f"the header of {table} is not {', '.join(names)}: "), F.col("record")))
    # as with Spark's reader, a header with other names or in another order is an error when the rows are read
    data = F.when(~F.col("first"), True).when(header == F.array(*map(F.lit, names)), False).otherwise(wrong.cast("boolean"))
    # a filter on a field of a plain column would parse the record again for each use; none is pushed below inline
    rows = csv_records.records(spark, path, breaks).select("first", "closed", "record", F.inline(F.array(row))).where(data)
    return rows.select(*names, CORRUPT, F.when(~F.col("closed"), F.col("record")).alias("_open"))


def ingest_csv(spark: SparkSession, paths: dict[str, str], breaks: set[str] = BREAKS) -> dict[str, Ingested]:
    """Nine raw CSV files or folders -> rows and rejects, keyed by silver table name.

    Every column is text.  A record with too few or too many fields, or whose quotes are
    still open at the end of its file, is a reject; the records around it are read.  Files of
    the tables in ``breaks`` may have line breaks inside quotes; they are split like the others.
    """
    out = {}
    for table, path in paths.items():
        names = schemas.columns(table)
        parsed = _parsed(spark, table, path, table in breaks)
        raw = F.coalesce("_open", CORRUPT)
        reason = F.when(F.col("_open").isNull(), "number of fields").otherwise("open quote")
        rejects = parsed.where(raw.isNotNull()).select(F.col(names[0]).alias("first_field"), reason.alias("reason"), raw.alias("raw_record"))
        out[table] = Ingested(parsed.where(raw.isNull()).select(*names), rejects, parsed.select(*names, raw.alias("raw_record")))
    return out


def read_csv(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Nine raw CSV files -> bronze DataFrames keyed by silver table name, without rejected records."""
    return {table: found.rows for table, found in ingest_csv(spark, paths).items()}


def csv_lines(df: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` as CSV records (``extra`` are further ones, as they stand), in one column."""
    made = df.select(F.to_csv(F.struct(*df.columns), {**OPTIONS, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("value"))
    return made.unionByName(extra.select("value")) if extra is not None else made


def write_csv(lines: DataFrame, names: list[str], path: str) -> None:
    """Write CSV records to files that begin with a header, a file for each partition that has records."""
    # the lower 33 bits are the place in the partition, which becomes a file
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    headed = F.when(first, F.concat(F.lit(",".join(names) + "\n"), F.coalesce("value", F.lit("")))).otherwise(F.col("value"))
    lines.select(headed.alias("value")).write.mode("overwrite").text(path)


def _text(c, dtype: str):
    if dtype in ("timestamp_ntz", "timestamp"):
        midnight = (F.hour(c) == 0) & (F.minute(c) == 0) & (F.second(c) == 0)
        # string casts of timestamp_ntz / date are wall-clock text, independent of the session time zone
        return F.when(midnight, F.to_date(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def render_dirty(tables: Tables) -> dict[str, DataFrame]:
    out = {}
    for table in schemas.TABLES:
        df = tables[table]
        cols = []
        for name, dtype, _ in schemas.SILVER_COLUMNS[table]:
            c = F.col(name)
            text = c.cast("int").cast("string") if name in ZIP_COLUMNS else _text(c, dtype.typeName())
            cols.append(F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), text, F.lit(" "))).alias(name))
        out[table] = df.select(*cols)
    return out


def register_staging(spark: SparkSession, bronze: dict[str, DataFrame]) -> list[str]:
    """Expose bronze frames as ``stg_*`` temporary views (the staging tables)."""
    names = []
    for table, df in bronze.items():
        name = schemas.BRONZE_NAMES[table]
        df.createOrReplaceTempView(name)
        names.append(name)
    return names
