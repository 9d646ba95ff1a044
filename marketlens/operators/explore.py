"""Foundational exploration queries.

Top-k reports are ``orderBy(...).limit(n)`` which Spark plans as
``TakeOrderedAndProject``: each task keeps its own top n and only n rows per
task reach the final merge.  Ties in the reference's ORDER BY are broken by
the row key (R16) so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import avg6, category_label, days_between, month_start, msum
from marketlens.functions.labels import DELAYED, NOT_DELAYED, TABLE_LABELS, UNCATEGORIZED
from marketlens.functions.parts import dealt
from marketlens.sources.catalog import Tables


PREVIEW_ORDER = {
    "customers": ["customer_id"],
    "orders": ["order_purchase_timestamp", "order_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["order_id", "review_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "category_translation": ["product_category_name"],
}


def table_row_counts(t: Tables, include_translation: bool = True) -> DataFrame:
    """Q01: (table_name, row_count) for the base tables, one scan each, one job."""
    names = [n for n in TABLE_LABELS if include_translation or n != "category_translation"]
    parts = [t[n].groupBy().agg(F.count("*").alias("row_count"))
             .select(F.lit(TABLE_LABELS[n]).alias("table_name"), "row_count") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.orderBy("table_name")


def table_preview(t: Tables, table: str, n: int = 10) -> DataFrame:
    """First n rows of a table in its natural key order."""
    return t[table].orderBy(*PREVIEW_ORDER[table]).limit(n)


#: Views with a key that orders their preview.
VIEW_PREVIEW_ORDER = {
    "geolocation_zip_prefix": ["geolocation_zip_code_prefix"],
    "order_payment": ["order_id"],
    "order_item_summary": ["order_id"],
    "order_review_score": ["order_id"],
    "product_sales_summary": ["sold_item_row_count desc", "product_id"],
    "kpi_snapshot": ["first_order_time"],
    "monthly_business_trend": ["order_month_start"],
    "customer_rfm": ["rfm_total_score desc", "customer_unique_id"],
    "customer_clv": ["clv_12m_estimate desc", "customer_unique_id"],
    "region_delivery_insight": ["late_delivery_rate desc", "customer_region"],
    "cross_sell_category_pairs": ["co_purchase_order_count desc", "category_a", "category_b"],
    "seller_retention": ["returning_customer_rate_percent desc", "seller_id"],
}


def view_preview(view: DataFrame, name: str, n: int = 10) -> DataFrame:
    """First n rows of a view in the order of its preview; the key breaks ties."""
    return view.orderBy(*[F.expr(c.removesuffix(" desc")).desc() if c.endswith(" desc") else F.col(c) for c in VIEW_PREVIEW_ORDER[name]]).limit(n)


def orders_vs_items_count(t: Tables) -> DataFrame:
    """Q02: two counts; the column takes the first branch's name."""
    a = t.orders.groupBy().agg(F.count("*").alias("total_orders")).select(
        F.lit("orders").alias("table_name"), "total_orders")
    b = t.order_items.groupBy().agg(F.count("*").alias("total_orders")).select(
        F.lit("order_items").alias("table_name"), "total_orders")
    return a.unionAll(b)


def distinct_orders_in_items(t: Tables) -> DataFrame:
    """Q03."""
    return t.order_items.groupBy().agg(
        F.countDistinct("order_id").alias("distinct_orders_in_order_items"),
        F.count("*").alias("item_row_count"))


def distinct_customer_states(t: Tables) -> DataFrame:
    """Q04."""
    return (t.customers.where(F.col("customer_state").isNotNull())
            .select("customer_state").distinct().orderBy("customer_state"))


def customers_in_city(t: Tables, city: str, n: int = 100) -> DataFrame:
    """Q05: case-insensitive city match, top n by id."""
    return (t.customers.where(F.lower("customer_city") == city.lower())
            .select("customer_id", "customer_unique_id", "customer_city", "customer_state",
                    "customer_zip_code_prefix")
            .orderBy("customer_id").limit(n))


def order_payments_in_window(t: Tables, start: str, end_exclusive: str, n: int = 200) -> DataFrame:
    """Q06: half-open purchase-time window; the range filter reaches the scan."""
    ts = F.col("order_purchase_timestamp")
    o = t.orders.where((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end_exclusive).cast("timestamp_ntz")))
    return (o.join(t.order_payments, "order_id")
            .select("order_id", "order_purchase_timestamp", "order_status", "payment_sequential",
                    "payment_type", "payment_installments", "payment_value")
            .orderBy("order_purchase_timestamp", "order_id", "payment_sequential").limit(n))


def top_orders_by_payment(t: Tables, n: int = 5) -> DataFrame:
    """Q07: payments summed per order (pre-aggregated before the join)."""
    p = t.order_payments.groupBy("order_id").agg(msum("payment_value").alias("total_payment"))
    return (t.orders.join(p, "order_id")
            .select("order_id", "order_purchase_timestamp", "order_status", "total_payment")
            .orderBy(F.col("total_payment").desc(), "order_id").limit(n))


def order_customer_item_seller(t: Tables, n: int = 200) -> DataFrame:
    """Q08: four-table detail rows."""
    return (t.orders.join(t.customers, "customer_id")
            .join(t.order_items, "order_id")
            .join(t.sellers, "seller_id")
            .select("order_id", "order_purchase_timestamp", "order_status", "customer_unique_id",
                    "customer_city", "customer_state", "order_item_id", "product_id", "price",
                    "freight_value", "seller_id", "seller_city", "seller_state")
            .orderBy("order_purchase_timestamp", "order_id", "order_item_id").limit(n))


def order_items_for_order(t: Tables, order_id: str) -> DataFrame:
    """Q09: one order's items with product and category (filter applied first)."""
    return (t.order_items.where(F.col("order_id") == order_id)
            .join(t.products, "product_id")
            .join(t.category_translation, "product_category_name", "left")
            .select("order_id", "order_item_id", "product_id", "product_category_name",
                    "product_category_name_english", "product_weight_g", "product_length_cm",
                    "product_height_cm", "product_width_cm", "product_photos_qty", "price",
                    "freight_value")
            .orderBy("order_item_id"))


def sellers_by_state(t: Tables) -> DataFrame:
    """Q10."""
    return (t.sellers.where(F.col("seller_state").isNotNull()).groupBy("seller_state")
            .agg(F.countDistinct("seller_id").alias("seller_count"))
            .orderBy(F.col("seller_count").desc(), "seller_state"))


def _items_category(t: Tables, default: str = UNCATEGORIZED) -> DataFrame:
    """Items joined to products (inner) and the translation (left), with a category label."""
    return (t.order_items.join(t.products.select("product_id", "product_category_name"), "product_id")
            .join(t.category_translation, "product_category_name", "left")
            .withColumn("product_category", category_label("product_category_name_english",
                                                           "product_category_name", default)))


def top_categories_by_orders(t: Tables, n: int = 10) -> DataFrame:
    """Q11."""
    return (_items_category(t).groupBy("product_category").agg(
        F.countDistinct("order_id").alias("order_count"), F.count("*").alias("item_row_count"))
        .orderBy(F.col("order_count").desc(), F.col("item_row_count").desc(), "product_category").limit(n))


def low_score_reviews(t: Tables, max_score: int = 3, n: int = 200) -> DataFrame:
    """Q12: reviews with score < max_score; review_id breaks the reference's ties."""
    r = t.order_reviews.where(F.col("review_score") < max_score)
    return (r.join(t.orders, "order_id").join(t.customers, "customer_id")
            .orderBy(F.col("review_score").asc(), F.col("order_purchase_timestamp").desc(), "order_id", "review_id")
            .select("order_id", "order_purchase_timestamp", "order_status", "review_score",
                    "review_comment_title", "review_comment_message", "customer_city", "customer_state")
            .limit(n))


def category_sales_in_seller_state(t: Tables, state: str, n: int = 50) -> DataFrame:
    """Q13: category sales of sellers in one state."""
    s = t.sellers.where(F.col("seller_state") == state).select("seller_id", "seller_state")
    items = _items_category(t).join(s, "seller_id")
    return (items.groupBy("seller_state", "product_category").agg(
        F.countDistinct("order_id").alias("order_count"), F.count("*").alias("item_row_count"),
        msum("price").alias("total_item_price"), msum("freight_value").alias("total_freight"))
        .orderBy(F.col("order_count").desc(), F.col("item_row_count").desc(), "product_category").limit(n))


def five_star_customers(t: Tables, n: int = 100) -> DataFrame:
    """Q14."""
    r = t.order_reviews.where(F.col("review_score") == 5).select("order_id")
    return (r.join(t.orders.select("order_id", "customer_id"), "order_id").join(t.customers, "customer_id")
            .groupBy("customer_unique_id", "customer_city", "customer_state")
            .agg(F.count("*").alias("five_star_review_count"))
            .orderBy(F.col("five_star_review_count").desc(), "customer_state", "customer_city",
                     "customer_unique_id").limit(n))


def _seller_items(t: Tables) -> DataFrame:
    """Items aggregated per seller first, then joined to sellers (seller_id is the key)."""
    return t.order_items.groupBy("seller_id").agg(
        F.countDistinct("order_id").alias("order_count"), F.count("*").alias("item_row_count"),
        msum("price").alias("total_item_price"), msum("freight_value").alias("total_freight"),
        avg6("price", 2).alias("avg_item_price"))


def top_sellers_by_orders(t: Tables, n: int = 5) -> DataFrame:
    """Q15."""
    return (_seller_items(t).join(t.sellers, "seller_id")
            .select("seller_id", "seller_city", "seller_state", "order_count", "item_row_count",
                    "total_item_price", "total_freight")
            .orderBy(F.col("order_count").desc(), F.col("item_row_count").desc(),
                     F.col("total_item_price").desc(), "seller_id").limit(n))


def order_status_counts(t: Tables) -> DataFrame:
    """Q16."""
    return (t.orders.groupBy("order_status").agg(F.count("*").alias("order_count"))
            .orderBy(F.col("order_count").desc(), "order_status"))


def largest_orders_by_items(t: Tables, n: int = 20) -> DataFrame:
    """Q17."""
    return (t.order_items.groupBy("order_id").agg(
        F.count("*").alias("item_row_count"), msum("price").alias("order_items_price"),
        msum("freight_value").alias("order_items_freight"))
        .orderBy(F.col("item_row_count").desc(), "order_id").limit(n))


def order_payment_summary(t: Tables, n: int = 20) -> DataFrame:
    """Q18: orders left-joined to payments aggregated per order."""
    p = t.order_payments.groupBy("order_id").agg(
        msum("payment_value").alias("total_payment"), F.count("*").alias("payment_row_count"))
    return (t.orders.join(p, "order_id", "left")
            .select("order_id", "order_purchase_timestamp", "order_status", "payment_row_count", "total_payment")
            .orderBy(F.col("total_payment").desc_nulls_last(), "order_id").limit(n))


def payment_vs_item_amount(t: Tables, n: int = 50) -> DataFrame:
    """Q19: payment total vs item total per order, largest absolute gaps first."""
    price0, freight0 = F.coalesce("price", F.lit(0)), F.coalesce("freight_value", F.lit(0))
    i = t.order_items.groupBy("order_id").agg(
        msum("price").alias("total_item_price"), msum("freight_value").alias("total_freight"),
        F.sum((price0 + freight0).cast("decimal(38,2)")).alias("item_amount"))
    p = t.order_payments.groupBy("order_id").agg(msum("payment_value").alias("total_payment"))
    diff = F.coalesce("total_payment", F.lit(0)) - F.coalesce("item_amount", F.lit(0))
    return (t.orders.join(i, "order_id", "left").join(p, "order_id", "left")
            .select("order_id", "order_status", "total_item_price", "total_freight", "item_amount",
                    "total_payment", diff.alias("payment_minus_item_amount"))
            .orderBy(F.abs("payment_minus_item_amount").desc(), "order_id").limit(n))


def monthly_orders_payment(t: Tables) -> DataFrame:
    """Q20: all statuses, per purchase month."""
    p = t.order_payments.groupBy("order_id").agg(msum("payment_value").alias("total_payment"))
    o = t.orders.where(F.col("order_purchase_timestamp").isNotNull())
    return (o.join(p, "order_id", "left")
            .groupBy(month_start("order_purchase_timestamp").alias("order_month"))
            .agg(F.count("*").alias("order_count"),
                 F.sum(F.coalesce("total_payment", F.lit(0))).alias("total_payment"))
            .orderBy("order_month"))


def category_revenue(t: Tables, n: int = 20) -> DataFrame:
    """Q21."""
    return (_items_category(t).groupBy("product_category").agg(
        F.countDistinct("order_id").alias("order_count"), F.count("*").alias("item_row_count"),
        msum("price").alias("total_item_price"), msum("freight_value").alias("total_freight"),
        avg6("price", 2).alias("avg_item_price"))
        .orderBy(F.col("total_item_price").desc(), F.col("order_count").desc(), "product_category").limit(n))


def seller_revenue(t: Tables, n: int = 100) -> DataFrame:
    """Q22."""
    s = _seller_items(t)
    return (t.sellers.join(s, "seller_id")
            .select("seller_id", "seller_city", "seller_state",
                    F.col("order_count").alias("seller_order_count"),
                    F.col("item_row_count").alias("seller_item_row_count"),
                    F.col("total_item_price").alias("seller_total_item_price"),
                    F.col("total_freight").alias("seller_total_freight"),
                    F.col("avg_item_price").alias("seller_avg_item_price"))
            .orderBy(F.col("seller_total_item_price").desc(), F.col("seller_order_count").desc(), "seller_id")
            .limit(n))


def delivery_time_detail(t: Tables, n: int = 200) -> DataFrame:
    """Q23."""
    o = t.orders.where(F.col("order_purchase_timestamp").isNotNull()
                       & F.col("order_delivered_customer_date").isNotNull()
                       & F.col("order_estimated_delivery_date").isNotNull())
    return (o.select("order_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
                     "order_estimated_delivery_date",
                     days_between("order_purchase_timestamp", "order_delivered_customer_date").alias("purchase_to_delivery_days"),
                     days_between("order_estimated_delivery_date", "order_delivered_customer_date").alias("estimated_vs_actual_days"))
            .orderBy(F.col("estimated_vs_actual_days").desc(), F.col("purchase_to_delivery_days").desc(), "order_id")
            .limit(n))


def review_score_by_delay(t: Tables) -> DataFrame:
    """Q24: late by *timestamp* (R6) vs on time; average of order-level averages."""
    d = (t.orders.where(F.col("order_delivered_customer_date").isNotNull()
                        & F.col("order_estimated_delivery_date").isNotNull())
         .select("order_id", F.when(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"),
                                    F.lit(DELAYED)).otherwise(F.lit(NOT_DELAYED)).alias("delayed_flag")))
    r = (t.order_reviews.where(F.col("review_score").isNotNull()).groupBy("order_id")
         .agg(avg6("review_score").alias("avg_review_score")))
    return (d.join(r, "order_id").groupBy("delayed_flag")
            .agg(F.count("*").alias("reviewed_order_count"), avg6("avg_review_score", 6).alias("avg_review_score"))
            .orderBy("delayed_flag"))


def state_flow_freight(t: Tables, n: int = 50) -> DataFrame:
    """Q25: customer state x seller state freight.

    An order is counted once per flow: items are summed per (flow, order) first, in tasks
    of like size, as orders are dealt to them whole.
    """
    oc = t.orders.select("order_id", "customer_id").join(t.customers.select("customer_id", "customer_state"), "customer_id")
    sold = t.order_items.select("order_id", "seller_id", "freight_value").join(t.sellers.select("seller_id", "seller_state"), "seller_id")
    by_order = (dealt(sold, t.order_items.count(), "order_id").join(oc.drop("customer_id"), "order_id")
                .groupBy("customer_state", "seller_state", "order_id").agg(
                    F.count("*").alias("__rows"), F.count("freight_value").alias("__known"), msum("freight_value").alias("__freight")))
    return (by_order.groupBy("customer_state", "seller_state").agg(
                F.count("order_id").alias("order_count"), F.sum("__rows").alias("item_row_count"),
                F.sum("__freight").cast("decimal(38,2)").alias("total_freight"),
                (F.sum("__freight") / F.nullif(F.sum("__known"), F.lit(0))).cast("decimal(38,6)").alias("avg_freight"))
            .orderBy(F.col("order_count").desc(), F.col("item_row_count").desc(), "customer_state", "seller_state")
            .limit(n))
