"""Order-grain fact views and the shared summaries built on them

Multi-row facts (payments, items, reviews) are aggregated to order grain
*before* they are joined (R11); the aggregates come out hash-partitioned on
``order_id`` so the following left joins reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.columns import (
    avg6, days_between, late_by_day, month_start, msum,
)
from marketlens.sources.catalog import Tables



def review2(c) -> "F.Column":
    """The order-level review average is rounded to 2 digits before it is averaged again."""
    return F.col(c).cast("decimal(10,2)") if isinstance(c, str) else c.cast("decimal(10,2)")


def geolocation_zip_prefix(t: Tables) -> DataFrame:
    """One row per zip prefix with the averaged coordinates.

    The average is exact over the decimal coordinates (scale 15), so it does
    not depend on row order across partitions.
    """
    g = t.geolocation.where(F.col("geolocation_zip_code_prefix").isNotNull())
    avg15 = lambda c: (F.sum(F.col(c).cast("decimal(38,15)")) / F.nullif(F.count(c), F.lit(0))).cast("decimal(38,15)")
    return g.groupBy("geolocation_zip_code_prefix").agg(
        avg15("geolocation_lat").alias("avg_geolocation_lat"),
        avg15("geolocation_lng").alias("avg_geolocation_lng"),
        F.max("geolocation_city").alias("example_city"),
        F.max("geolocation_state").alias("example_state"),
        F.count("*").alias("source_row_count"),
    )


def order_payment(t: Tables) -> DataFrame:
    """Payments at order grain."""
    return t.order_payments.groupBy("order_id").agg(
        F.count("*").alias("payment_record_count"),
        F.countDistinct("payment_type").alias("payment_type_count"),
        F.max(F.coalesce("payment_installments", F.lit(0))).alias("max_payment_installments"),
        msum("payment_value").alias("total_payment_value"),
    )


def order_item_summary(t: Tables) -> DataFrame:
    """Items at order grain.

    The two distinct counts are computed as separate two-level aggregations
    keyed by order_id ((order, product) then order; (order, seller) then
    order) and joined back on order_id, instead of one aggregate with an
    ``Expand`` that doubles the rows.  Every step is clustered by order_id,
    so on items bucketed by order_id the whole view runs without a shuffle.
    """
    items = t.order_items
    price0 = F.coalesce("price", F.lit(0))
    freight0 = F.coalesce("freight_value", F.lit(0))
    totals = items.groupBy("order_id").agg(
        F.count("*").alias("item_row_count"),
        msum("price").alias("product_gmv"),
        msum("freight_value").alias("freight_value"),
        F.sum((price0 + freight0).cast("decimal(38,2)")).alias("item_total_value"),
    )

    def distinct_count(col: str, out: str) -> DataFrame:
        pairs = items.where(F.col(col).isNotNull()).select("order_id", col).distinct()
        return pairs.groupBy("order_id").agg(F.count("*").alias(out))

    return (totals.join(distinct_count("product_id", "product_count"), "order_id", "left")
            .join(distinct_count("seller_id", "seller_count"), "order_id", "left")
            .select("order_id", "item_row_count",
                    F.coalesce("product_count", F.lit(0)).alias("product_count"),
                    F.coalesce("seller_count", F.lit(0)).alias("seller_count"),
                    "product_gmv", "freight_value", "item_total_value"))


def order_review_score(t: Tables) -> DataFrame:
    """Reviews at order grain; the score average is exact decimal(38,6)."""
    return t.order_reviews.groupBy("order_id").agg(
        avg6("review_score").alias("avg_review_score"),
        F.count("*").alias("review_row_count"),
        F.countDistinct("review_id").alias("review_id_count"),
        F.max("review_creation_date").alias("latest_review_creation_date"),
        F.max("review_answer_timestamp").alias("latest_review_answer_timestamp"),
    )


V04_COLUMNS = [
    "order_id", "customer_id", "customer_unique_id", "customer_city", "customer_state",
    "order_status", "order_purchase_timestamp", "order_year", "order_month", "order_month_start",
    "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
    "order_estimated_delivery_date", "payment_record_count", "payment_type_count",
    "max_payment_installments", "total_payment_value", "item_row_count", "product_count",
    "seller_count", "product_gmv", "freight_value", "item_total_value", "avg_review_score",
    "review_row_count", "purchase_to_delivery_days", "purchase_to_approval_days",
    "approval_to_carrier_days", "carrier_to_customer_days", "delivery_delay_days",
    "late_delivery_flag",
]


def delivered_order_base(t: Tables) -> DataFrame:
    """One row per delivered order with its payment, item and review facts.

    Orders without payments/items keep zeros; review average and count stay
    NULL (R10).  The status filter is pushed to the orders scan.
    """
    return t.view("delivered_order_base", lambda: _delivered_order_base(t))


def _delivered_order_base(t: Tables) -> DataFrame:
    o = t.orders.where(F.col("order_status") == "delivered")
    c = t.customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state")
    # The three order-grain aggregates are joined first, on order_id, so
    # they share one partitioning (none at all when the facts are bucketed
    # by order_id); the customer attributes are joined last.
    df = (o.join(order_payment(t), "order_id", "left")
           .join(order_item_summary(t), "order_id", "left")
           .join(order_review_score(t).select("order_id", "avg_review_score", "review_row_count"),
                 "order_id", "left")
           .join(c, "customer_id"))
    pt, ap = F.col("order_purchase_timestamp"), F.col("order_approved_at")
    car, dl = F.col("order_delivered_carrier_date"), F.col("order_delivered_customer_date")
    est = F.col("order_estimated_delivery_date")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return df.select(
        "order_id", "customer_id", "customer_unique_id", "customer_city", "customer_state",
        "order_status", "order_purchase_timestamp",
        F.year(pt).alias("order_year"), F.month(pt).alias("order_month"),
        month_start(pt).alias("order_month_start"),
        "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
        "order_estimated_delivery_date",
        zero("payment_record_count"), zero("payment_type_count"), zero("max_payment_installments"),
        zero("total_payment_value"),
        zero("item_row_count"), zero("product_count"), zero("seller_count"), zero("product_gmv"),
        zero("freight_value"), zero("item_total_value"),
        "avg_review_score", "review_row_count",
        days_between(pt, dl).alias("purchase_to_delivery_days"),
        days_between(pt, ap).alias("purchase_to_approval_days"),
        days_between(ap, car).alias("approval_to_carrier_days"),
        days_between(car, dl).alias("carrier_to_customer_days"),
        days_between(est, dl).alias("delivery_delay_days"),
        late_by_day(dl, est).alias("late_delivery_flag"),
    )


def order_seller_base(t: Tables) -> DataFrame:
    """Order x seller grain.

    Items are aggregated by (order_id, seller_id) first and the seller
    attributes joined afterwards: seller_id is the sellers key, so this is the
    same grouping as grouping by the joined city/state, with the join done on
    the (smaller) aggregated side.
    """
    agg = t.order_items.groupBy("order_id", "seller_id").agg(
        F.count("*").alias("seller_item_row_count"),
        F.countDistinct("product_id").alias("seller_product_count"),
        msum("price").alias("seller_product_gmv"),
        msum("freight_value").alias("seller_freight_value"),
        F.min("shipping_limit_date").alias("first_shipping_limit_date"),
        F.max("shipping_limit_date").alias("last_shipping_limit_date"),
    )
    s = t.sellers.select("seller_id", "seller_city", "seller_state")
    return agg.join(s, "seller_id", "left").select(
        "order_id", "seller_id", "seller_city", "seller_state", "seller_item_row_count",
        "seller_product_count", "seller_product_gmv", "seller_freight_value",
        "first_shipping_limit_date", "last_shipping_limit_date")


def seller_order_analysis(t: Tables, dob: DataFrame | None = None) -> DataFrame:
    """V05 joined to the delivered order facts (R12: order facts repeat per seller)."""
    if dob is None:
        return t.view("seller_order_analysis", lambda: seller_order_analysis(t, delivered_order_base(t)))
    d = dob.select(
        "order_id", "customer_unique_id", "customer_city", "customer_state",
        "order_purchase_timestamp", "order_year", "order_month", "order_month_start",
        F.col("total_payment_value").alias("order_total_payment_value"),
        F.col("product_gmv").alias("order_product_gmv"),
        F.col("freight_value").alias("order_freight_value"),
        "avg_review_score", "purchase_to_delivery_days", "delivery_delay_days", "late_delivery_flag")
    return order_seller_base(t).join(d, "order_id").select(
        "order_id", "seller_id", "seller_city", "seller_state", "customer_unique_id",
        "customer_city", "customer_state", "order_purchase_timestamp", "order_year",
        "order_month", "order_month_start", "seller_item_row_count", "seller_product_count",
        "seller_product_gmv", "seller_freight_value", "order_total_payment_value",
        "order_product_gmv", "order_freight_value", "avg_review_score",
        "purchase_to_delivery_days", "delivery_delay_days", "late_delivery_flag")


def monthly_business(t: Tables, dob: DataFrame | None = None) -> DataFrame:
    """Delivered-order KPIs per purchase month."""
    dob = dob if dob is not None else delivered_order_base(t)
    return dob.groupBy("order_year", "order_month", "order_month_start").agg(
        F.count("*").alias("delivered_order_count"),
        F.countDistinct("customer_unique_id").alias("buyer_count"),
        F.sum("total_payment_value").alias("total_payment_value"),
        F.sum("product_gmv").alias("product_gmv"),
        F.sum("freight_value").alias("freight_value"),
        avg6("total_payment_value", 2).alias("avg_payment_per_order"),
        avg6("purchase_to_delivery_days").alias("avg_delivery_days"),
        avg6("late_delivery_flag").alias("late_delivery_rate"),
        avg6(review2("avg_review_score"), 2).alias("avg_review_score"),
    )


def customer_summary(t: Tables, dob: DataFrame | None = None) -> DataFrame:
    """One row per person (customer_unique_id).

    ``COUNT(DISTINCT order_id)`` is ``count(*)`` here: order_id is unique in
    V04 (audited by A02), which avoids a second distinct aggregation.
    """
    if dob is None:
        return t.view("customer_summary", lambda: customer_summary(t, delivered_order_base(t)))
    return dob.where(F.col("customer_unique_id").isNotNull()).groupBy("customer_unique_id").agg(
        F.count("*").alias("delivered_order_count"),
        F.sum("total_payment_value").alias("total_payment_value"),
        F.sum("product_gmv").alias("product_gmv"),
        F.sum("freight_value").alias("freight_value"),
        avg6("total_payment_value", 2).alias("avg_payment_per_order"),
        F.min("order_purchase_timestamp").alias("first_purchase_time"),
        F.max("order_purchase_timestamp").alias("last_purchase_time"),
        days_between(F.min("order_purchase_timestamp"), F.max("order_purchase_timestamp"))
        .alias("customer_lifetime_days"),
        avg6(review2("avg_review_score"), 2).alias("avg_review_score"),
        avg6("late_delivery_flag").alias("late_delivery_rate"),
    )


def seller_summary(t: Tables, soa: DataFrame | None = None) -> DataFrame:
    """One row per seller; (order_id, seller_id) is unique in V06."""
    if soa is None:
        return t.view("seller_summary", lambda: seller_summary(t, seller_order_analysis(t)))
    return soa.groupBy("seller_id", "seller_city", "seller_state").agg(
        F.count("*").alias("delivered_order_count"),
        F.countDistinct("customer_unique_id").alias("buyer_count"),
        F.sum("seller_item_row_count").alias("seller_item_row_count"),
        F.sum("seller_product_gmv").alias("seller_product_gmv"),
        F.sum("seller_freight_value").alias("seller_freight_value"),
        avg6(review2("avg_review_score"), 2).alias("avg_review_score"),
        F.count("avg_review_score").alias("reviewed_order_count"),
        avg6("purchase_to_delivery_days").alias("avg_delivery_days"),
        avg6("late_delivery_flag").alias("late_delivery_rate"),
    )


def logistics_state_flow(t: Tables, soa: DataFrame | None = None) -> DataFrame:
    """Seller state x customer state delivery flow."""
    soa = soa if soa is not None else seller_order_analysis(t)
    return (soa.where(F.col("seller_state").isNotNull() & F.col("customer_state").isNotNull())
            .groupBy("seller_state", "customer_state").agg(
                F.countDistinct("order_id").alias("delivered_order_count"),
                F.countDistinct("seller_id").alias("seller_count"),
                F.countDistinct("customer_unique_id").alias("buyer_count"),
                F.sum("seller_product_gmv").alias("seller_product_gmv"),
                avg6("purchase_to_delivery_days").alias("avg_delivery_days"),
                avg6("delivery_delay_days").alias("avg_delay_days"),
                avg6("late_delivery_flag").alias("late_delivery_rate"),
            ))
