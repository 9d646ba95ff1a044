"""Registered queries over raw CSV files, with SQL twins.

The given tables are written as CSV to the shared folder, with quotes, separators and line
breaks in review texts and with records that do not fit, and read again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import integrity
from marketlens.plans import rebuild
from marketlens.plans.oracle_base import LIB
from marketlens.plans.registry import ORACLE, QUERIES
from marketlens.session import ensure_checkpoint_dir
from marketlens.sources import bronze, catalog, schemas

_WRITTEN: dict[tuple[str, str, str], str] = {}


def _number(column: str):
    return F.substring(column, 2, 30).cast("bigint")


def _messages(reviews: DataFrame) -> DataFrame:
    n, text = _number("review_id"), F.col("review_comment_message")
    two = F.concat(text, F.lit('\nsecond, "quoted" line'))
    return reviews.withColumn("review_comment_message", F.when(n % 4 == 0, text).when(n % 4 == 1, two)
                              .when(n % 4 == 2, F.concat(F.lit("\n"), text, F.lit("\n\n"))).otherwise(F.lit('"')))


def written(spark: SparkSession, sf_dir: str, names: list[str] = schemas.TABLES) -> dict[str, str]:
    """Folders of CSV files of the tables, each written once per session.

    Every tenth order is followed by a record of two fields, every seventh review by one of eight.
    """
    tables = catalog.load(spark, sf_dir)
    tables = tables.with_frames(order_reviews=_messages(tables["order_reviews"]))
    raw = bronze.render_dirty(tables)
    extra = {"orders": tables["orders"].where(_number("order_id") % 10 == 3).select(F.concat("order_id", F.lit(",cut off")).alias("value")),
             "order_reviews": tables["order_reviews"].where(_number("review_id") % 7 == 3).select(F.concat("review_id", F.lit(',"a\nb",,,,,,')).alias("value"))}
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}"
    for table in names:
        key = (spark.sparkContext.applicationId, sf_dir, table)
        if key not in _WRITTEN:
            bronze.write_csv(bronze.csv_lines(raw[table], extra.get(table)), schemas.columns(table), f"{root}/{table}")
            _WRITTEN[key] = f"{root}/{table}"
    return {t: _WRITTEN[spark.sparkContext.applicationId, sf_dir, t] for t in names}


def csv_order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews from CSV with quotes, separators and line breaks in their texts."""
    return bronze.read_csv(spark, written(spark, sf_dir, ["order_reviews"]))["order_reviews"]


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that do not fit, of all tables."""
    found = bronze.ingest_csv(spark, written(spark, sf_dir))
    parts = [x.rejects.select(F.lit(t).alias("table_name"), "first_field", "reason", "raw_record") for t, x in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def csv_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected records of every table, in one pass over its files."""
    out = None
    for table, x in bronze.ingest_csv(spark, written(spark, sf_dir)).items():
        one = x.judged.groupBy().agg(F.count_if(F.col("raw_record").isNull()).alias("accepted_rows"), F.count("raw_record").alias("rejected_rows")).select(
            F.lit(table).alias("table_name"), "accepted_rows", "rejected_rows")
        out = one if out is None else out.unionAll(one)
    return out


QUERIES["csv_order_reviews"] = csv_order_reviews
QUERIES["csv_rejects"] = csv_rejects
QUERIES["csv_ingest_counts"] = csv_ingest_counts

_ID = "CAST(substr({}, 2) AS BIGINT)"
# an empty field is read as NULL
_rest = ", ".join(f"nullif({n}, '') AS {n}" for n in schemas.columns("order_reviews") if n != "review_comment_message")
_n = _ID.format("trim(review_id)")
_text = "substr(review_comment_message, 2, length(review_comment_message) - 2)"
ORACLE["csv_order_reviews"] = LIB.build(f"""
SELECT {_rest}, CASE WHEN {_n} % 4 = 3 THEN ' " ' WHEN review_comment_message = '' THEN NULL
  ELSE ' ' || CASE {_n} % 4 WHEN 0 THEN {_text} WHEN 1 THEN {_text} || chr(10) || 'second, "quoted" line'
       ELSE chr(10) || {_text} || chr(10) || chr(10) END || ' ' END AS review_comment_message
FROM stg_order_reviews""")
_bad_orders = f"FROM sv_orders WHERE {_ID.format('order_id')} % 10 = 3"
_bad_reviews = f"FROM sv_order_reviews WHERE {_ID.format('review_id')} % 7 = 3"
ORACLE["csv_rejects"] = LIB.build(f"""
SELECT 'orders' AS table_name, order_id AS first_field, 'number of fields' AS reason, order_id || ',cut off' AS raw_record {_bad_orders}
UNION ALL SELECT 'order_reviews', review_id, 'number of fields', review_id || ',"a' || chr(10) || 'b",,,,,,' {_bad_reviews}""")
_counts = {"orders": f"(SELECT count(*) {_bad_orders})", "order_reviews": f"(SELECT count(*) {_bad_reviews})"}
ORACLE["csv_ingest_counts"] = LIB.build(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS accepted_rows, CAST({_counts.get(t, '0')} AS BIGINT) AS rejected_rows FROM sv_{t}" for t in schemas.TABLES))

# ----------------------------------------------------------------- rebuild from the CSV files
_PUBLISHED = ["v_phase3_monthly_business", "v_phase3_customer_summary", "v_phase3_seller_summary"]


def _rebuilt(spark: SparkSession, sf_dir: str) -> rebuild.Published:
    """All tables and three views, rebuilt from the CSV files and read where ``CURRENT`` points."""
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/published-{hashlib.sha1(sf_dir.encode()).hexdigest()[:12]}"
    rebuild.rebuild(spark, bronze.read_csv(spark, written(spark, sf_dir)), out, names=_PUBLISHED)
    return rebuild.published(spark, out)


def rebuilt_monthly_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly figures of a version that was rebuilt from CSV and published."""
    return _rebuilt(spark, sf_dir).views["v_phase3_monthly_business"]


def rebuilt_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table and view of a version that was rebuilt from CSV and published."""
    now = _rebuilt(spark, sf_dir)
    frames = {**{t: now.tables[t] for t in schemas.TABLES}, **now.views}
    return integrity.union_all([df.groupBy().agg(F.count("*").alias("row_count")).select(F.lit(n).alias("name"), "row_count") for n, df in frames.items()])


QUERIES["rebuilt_monthly_business"] = rebuilt_monthly_business
QUERIES["rebuilt_row_counts"] = rebuilt_row_counts
ORACLE["rebuilt_monthly_business"] = LIB.build("SELECT * FROM v_monthly_business")
ORACLE["rebuilt_row_counts"] = LIB.build(" UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS row_count FROM {source}" for name, source in
    [*((t, f"sv_{t}") for t in schemas.TABLES), *zip(_PUBLISHED, ("v_monthly_business", "v_customer_summary", "v_seller_summary"))]))
