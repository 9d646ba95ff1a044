"""Bronze -> silver cleaning.

Every column is trimmed and blank-to-NULL'd (R1), zip codes keep the
rightmost five of '00000' || zip (R2), numbers and timestamps that do not
parse become NULL instead of failing (R3), review titles are cut at 255
characters.  Rows whose key is NULL after cleaning are dropped.  All of it is
narrow (per-row) work: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import clean_str, left_str, try_dec, try_int, try_ts, zip5
from marketlens.sources import schemas
from marketlens.sources.bronze import ZIP_COLUMNS

# Rows are kept only when these cleaned columns are not NULL.
REQUIRED = {
    "customers": ["customer_id"],
    "category_translation": ["product_category_name"],
    "sellers": ["seller_id"],
    "products": ["product_id"],
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["review_id", "order_id"],
    "geolocation": [],
}
TRUNCATE = {("order_reviews", "review_comment_title"): 255}


def _convert(table: str, name: str, dtype) -> "F.Column":
    kind = dtype.typeName()
    if name in ZIP_COLUMNS:
        return zip5(name)
    if (table, name) in TRUNCATE:
        return left_str(name, TRUNCATE[(table, name)])
    if kind == "integer":
        return try_int(name)
    if kind == "decimal":
        return try_dec(name, dtype.precision, dtype.scale)
    if kind in ("timestamp_ntz", "timestamp"):
        return try_ts(name)
    return clean_str(name)


def clean_table(table: str, bronze: DataFrame) -> DataFrame:
    cols = [_convert(table, n, t).cast(t).alias(n) for n, t, _ in schemas.SILVER_COLUMNS[table]]
    df = bronze.select(*cols)
    for key in REQUIRED[table]:
        df = df.where(F.col(key).isNotNull())
    return df


def clean_all(bronze: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {t: clean_table(t, bronze[t]) for t in schemas.TABLES}
