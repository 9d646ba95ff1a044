"""Bronze (all text) and silver (typed) schemas of the nine base tables,
with the declared primary and foreign keys.

Silver timestamps are ``TIMESTAMP_NTZ``: the source stores wall-clock times
with second precision and no zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I = T.StringType(), T.IntegerType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(18, 2)
COORD = T.DecimalType(18, 15)

TABLES = [
    "customers", "category_translation", "sellers", "products", "orders",
    "order_items", "order_payments", "order_reviews", "geolocation",
]

# Column name, type, declared NOT NULL.
SILVER_COLUMNS: dict[str, list[tuple[str, T.DataType, bool]]] = {
    "customers": [
        ("customer_id", S, True), ("customer_unique_id", S, False),
        ("customer_zip_code_prefix", S, False), ("customer_city", S, False),
        ("customer_state", S, False)],
    "category_translation": [
        ("product_category_name", S, True), ("product_category_name_english", S, False)],
    "sellers": [
        ("seller_id", S, True), ("seller_zip_code_prefix", S, False),
        ("seller_city", S, False), ("seller_state", S, False)],
    "products": [
        ("product_id", S, True), ("product_category_name", S, False),
        ("product_name_lenght", I, False), ("product_description_lenght", I, False),
        ("product_photos_qty", I, False), ("product_weight_g", I, False),
        ("product_length_cm", I, False), ("product_height_cm", I, False),
        ("product_width_cm", I, False)],
    "orders": [
        ("order_id", S, True), ("customer_id", S, True), ("order_status", S, False),
        ("order_purchase_timestamp", TS, False), ("order_approved_at", TS, False),
        ("order_delivered_carrier_date", TS, False), ("order_delivered_customer_date", TS, False),
        ("order_estimated_delivery_date", TS, False)],
    "order_items": [
        ("order_id", S, True), ("order_item_id", I, True), ("product_id", S, False),
        ("seller_id", S, False), ("shipping_limit_date", TS, False),
        ("price", MONEY, False), ("freight_value", MONEY, False)],
    "order_payments": [
        ("order_id", S, True), ("payment_sequential", I, True), ("payment_type", S, False),
        ("payment_installments", I, False), ("payment_value", MONEY, False)],
    "order_reviews": [
        ("review_id", S, True), ("order_id", S, True), ("review_score", I, False),
        ("review_comment_title", S, False), ("review_comment_message", S, False),
        ("review_creation_date", TS, False), ("review_answer_timestamp", TS, False)],
    "geolocation": [
        ("geolocation_zip_code_prefix", S, False), ("geolocation_lat", COORD, False),
        ("geolocation_lng", COORD, False), ("geolocation_city", S, False),
        ("geolocation_state", S, False)],
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "customers": ["customer_id"],
    "category_translation": ["product_category_name"],
    "sellers": ["seller_id"],
    "products": ["product_id"],
    "orders": ["order_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["review_id", "order_id"],
    # geolocation's key is a surrogate identity column that no query reads.
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
]

# Default staging-table names of the nine raw text tables (override per call).
BRONZE_NAMES: dict[str, str] = {
    "customers": "stg_customers_dataset",
    "category_translation": "stg_product_category_name_translation",
    "sellers": "stg_sellers_dataset",
    "products": "stg_products_dataset",
    "orders": "stg_orders_dataset",
    "order_items": "stg_order_items_dataset",
    "order_payments": "stg_order_payments_dataset",
    "order_reviews": "stg_order_reviews_dataset",
    "geolocation": "stg_geolocation_dataset",
}


def silver_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, t, not nn) for n, t, nn in SILVER_COLUMNS[table]])


def bronze_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(n, S, True) for n, _, _ in SILVER_COLUMNS[table]])


def columns(table: str) -> list[str]:
    return [n for n, _, _ in SILVER_COLUMNS[table]]
