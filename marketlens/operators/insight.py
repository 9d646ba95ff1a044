"""Business insight views.

Decimal arithmetic follows the same precision/scale rules as the original
(Spark's decimal rules with precision loss allowed are the SQL Server
rules), so ratios, CLV and growth rates are exact decimals, not doubles.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import labels as L
from marketlens.functions.columns import avg6, days_between, month_start, msum_nullable, weekday0
from marketlens.functions.pairs import DEFAULT_CHUNK, pair_counts
from marketlens.functions.parts import dealt
from marketlens.functions.ranking import global_ntile, global_ntiles, stable
from marketlens.operators import base
from marketlens.sources.catalog import Tables

def _d100():
    return F.lit(Decimal("100.0"))


def growth_pct(cur, prev) -> "F.Column":
    """ROUND(100.0 * (cur - prev) / NULLIF(prev, 0), 2) on decimals."""
    cur, prev = F.col(cur), F.col(prev)
    return F.round(_d100() * (cur - prev) / F.nullif(prev, F.lit(0)), 2).cast("decimal(38,2)")


def share_pct(part, total) -> "F.Column":
    """ROUND(100.0 * part / NULLIF(total, 0), 2) for integer counts."""
    return F.round(_d100() * part / F.nullif(total, F.lit(0)), 2).cast("decimal(38,2)")


def kpi_snapshot(t: Tables) -> DataFrame:
    """One KPI row; the seller count is a scalar subquery."""
    dob = base.delivered_order_base(t)
    k = dob.groupBy().agg(
        F.count("*").alias("delivered_order_count"),
        F.countDistinct("customer_unique_id").alias("buyer_count"),
        F.sum("total_payment_value").alias("total_payment_value"),
        F.sum("product_gmv").alias("product_gmv"),
        F.sum("freight_value").alias("freight_value"),
        avg6("total_payment_value", 2).alias("avg_payment_per_order"),
        avg6("product_gmv", 2).alias("avg_product_gmv_per_order"),
        avg6(base.review2("avg_review_score"), 2).alias("avg_review_score"),
        avg6("purchase_to_delivery_days").alias("avg_delivery_days"),
        avg6("late_delivery_flag").alias("late_delivery_rate"),
        F.min("order_purchase_timestamp").alias("first_order_time"),
        F.max("order_purchase_timestamp").alias("last_order_time"))
    sellers = base.seller_order_analysis(t).select("seller_id").distinct().groupBy().agg(F.count("*").alias("seller_count"))
    return k.withColumn("seller_count", sellers.scalar()).select(
        "delivered_order_count", "buyer_count", "seller_count", "total_payment_value", "product_gmv",
        "freight_value", "avg_payment_per_order", "avg_product_gmv_per_order", "avg_review_score",
        "avg_delivery_days", "late_delivery_rate", "first_order_time", "last_order_time")


def _delivered_items_categorised(t: Tables, customer_cols: list[str] | None = None) -> DataFrame:
    """Delivered order items with category labels ('unknown' fallback).

    Customer attributes, when needed, are joined to the orders first (order
    grain), so the item rows are shuffled only once, by order_id, and not at
    all when items are bucketed by order_id.
    """
    o = t.orders.where(F.col("order_status") == "delivered")
    if customer_cols:
        o = o.join(t.customers.select("customer_id", *customer_cols), "customer_id")
    p = t.products.select("product_id", "product_category_name")
    return (t.order_items.join(o, "order_id")
            .join(p, "product_id", "left")
            .join(t.category_translation, "product_category_name", "left")
            .withColumn("product_category_name_english",
                        F.coalesce("product_category_name_english", "product_category_name", F.lit(L.UNKNOWN)))
            .withColumn("product_category_name", F.coalesce("product_category_name", F.lit(L.UNKNOWN))))


def category_seller_region_gmv(t: Tables) -> DataFrame:
    """Category x seller x customer region (SUM keeps NULL for unknown prices).

    An order has one buyer, so the distinct counts nest: rows per (group, buyer, order),
    then per (group, buyer), then per group.  No row is expanded once per count.  The first
    two stay in tasks of like size, as all orders of a buyer in a group are dealt to one.
    """
    s = t.sellers.select("seller_id", "seller_state", "seller_city")
    d = (_delivered_items_categorised(t, ["customer_unique_id", "customer_state"])
         .withColumnRenamed("customer_state", "customer_region").join(s, "seller_id", "left"))
    key = ["product_category_name", "product_category_name_english", "seller_id", "seller_state", "seller_city", "customer_region"]
    sums = [F.sum(c).alias(c) for c in ("sold_item_row_count", "__priced")] + [msum_nullable(c).alias(c) for c in ("product_gmv", "freight_value")]
    d = dealt(d, t.order_items.count(), "seller_id", "customer_unique_id", "product_category_name")
    by_order = d.groupBy(*key, "customer_unique_id", "order_id").agg(
        F.count("*").alias("sold_item_row_count"), F.count("price").alias("__priced"),
        msum_nullable("price").alias("product_gmv"), msum_nullable("freight_value").alias("freight_value"))
    by_buyer = by_order.groupBy(*key, "customer_unique_id").agg(*sums, F.count("order_id").alias("delivered_order_count"))
    out = by_buyer.groupBy(*key).agg(*sums, F.sum("delivered_order_count").alias("delivered_order_count"),
                                     F.count("customer_unique_id").alias("buyer_count"))
    return out.select(*key, "sold_item_row_count", "delivered_order_count", "buyer_count", "product_gmv", "freight_value",
                      (F.col("product_gmv") / F.nullif(F.col("__priced"), F.lit(0))).cast("decimal(38,6)").alias("avg_item_price"))


def category_seller_region_top(t: Tables, n: int = 100) -> DataFrame:
    return (category_seller_region_gmv(t)
            .select("product_category_name_english", "seller_id", "seller_state", "customer_region",
                    "sold_item_row_count", "delivered_order_count", "buyer_count", "product_gmv",
                    "freight_value", "avg_item_price", "product_category_name", "seller_city")
            .orderBy(F.col("product_gmv").desc_nulls_last(), F.col("sold_item_row_count").desc(),
                     "product_category_name", "seller_id", "customer_region")
            .drop("product_category_name", "seller_city").limit(n))


def monthly_category_gmv(t: Tables) -> DataFrame:
    """B03."""
    d = _delivered_items_categorised(t).where(F.col("order_purchase_timestamp").isNotNull())
    pt = F.col("order_purchase_timestamp")
    return d.groupBy(F.year(pt).alias("order_year"), F.month(pt).alias("order_month"),
                     month_start(pt).alias("order_month_start"),
                     "product_category_name", "product_category_name_english").agg(
        F.count("*").alias("sold_item_row_count"),
        F.countDistinct("order_id").alias("delivered_order_count"),
        msum_nullable("price").alias("product_gmv"),
        msum_nullable("freight_value").alias("freight_value"))


def monthly_category_top(t: Tables, n: int = 100) -> DataFrame:
    return (monthly_category_gmv(t)
            .orderBy("order_month_start", F.col("product_gmv").desc_nulls_last(), "product_category_name")
            .select("order_month_start", "product_category_name_english", "sold_item_row_count",
                    "delivered_order_count", "product_gmv", "freight_value").limit(n))


def monthly_business_trend(t: Tables, dob: DataFrame | None = None) -> DataFrame:
    """As V07 with a non-NULL month start."""
    dob = dob if dob is not None else base.delivered_order_base(t)
    return dob.where(F.col("order_month_start").isNotNull()).groupBy(
        "order_year", "order_month", "order_month_start").agg(
        F.count("*").alias("delivered_order_count"),
        F.countDistinct("customer_unique_id").alias("buyer_count"),
        F.sum("total_payment_value").alias("total_payment_value"),
        F.sum("product_gmv").alias("product_gmv"),
        F.sum("freight_value").alias("freight_value"),
        avg6("total_payment_value", 2).alias("avg_payment_per_order"),
        avg6(base.review2("avg_review_score"), 2).alias("avg_review_score"),
        avg6("purchase_to_delivery_days").alias("avg_delivery_days"),
        avg6("late_delivery_flag").alias("late_delivery_rate"))


def yoy_growth(t: Tables) -> DataFrame:
    """Yearly totals with LAG over the (few) year rows."""
    y = (base.delivered_order_base(t).where(F.col("order_year").isNotNull()).groupBy("order_year").agg(
        F.count("*").alias("delivered_order_count"),
        F.sum("total_payment_value").alias("total_payment_value"),
        F.sum("product_gmv").alias("product_gmv")))
    w = Window.orderBy("order_year")
    y = (y.withColumn("previous_year_payment_value", F.lag("total_payment_value").over(w))
          .withColumn("previous_year_product_gmv", F.lag("product_gmv").over(w)))
    return y.select(
        "order_year", "delivered_order_count", "total_payment_value", "previous_year_payment_value",
        growth_pct("total_payment_value", "previous_year_payment_value").alias("payment_yoy_growth_rate_percent"),
        "product_gmv", "previous_year_product_gmv",
        growth_pct("product_gmv", "previous_year_product_gmv").alias("product_gmv_yoy_growth_rate_percent"))


def weekday_vs_weekend(t: Tables) -> DataFrame:
    """Purchase weekday (R24: 0 = Monday, locale independent)."""
    d = (base.delivered_order_base(t).where(F.col("order_purchase_timestamp").isNotNull())
         .withColumn("__wd", weekday0("order_purchase_timestamp")))
    name = None
    for i, nm in enumerate(L.WEEKDAY_NAMES):
        name = F.when(F.col("__wd") == i, nm) if name is None else name.when(F.col("__wd") == i, nm)
    return d.groupBy((F.col("__wd") + 1).alias("weekday_number_monday_1"), name.alias("weekday_name_en"),
                     F.when(F.col("__wd").isin(5, 6), L.WEEKEND).otherwise(L.WEEKDAY).alias("day_type")).agg(
        F.count("*").alias("delivered_order_count"),
        F.countDistinct("customer_unique_id").alias("buyer_count"),
        F.sum("total_payment_value").alias("total_payment_value"),
        F.sum("product_gmv").alias("product_gmv"),
        avg6("total_payment_value", 2).alias("avg_payment_per_order")).orderBy("weekday_number_monday_1")


def customer_value_tiers(t: Tables) -> DataFrame:
    """Three global quartiles per person and a tier."""
    cs = stable(base.customer_summary(t), t.gold_dir is None) \
        .withColumn("__review0", F.coalesce("avg_review_score", F.lit(0)))
    cs = global_ntiles(cs, [(4, [("total_payment_value", True)], "payment_quartile"),
                            (4, [("delivered_order_count", True)], "frequency_quartile"),
                            (4, [("__review0", True)], "review_quartile")], "customer_unique_id")
    pq, fq = F.col("payment_quartile"), F.col("frequency_quartile")
    tier = (F.when((pq == 4) & (fq >= 3), L.TIER_HIGH_VALUE_REPEAT).when(pq == 4, L.TIER_HIGH_TICKET)
            .when(fq == 4, L.TIER_FREQUENT).when((pq == 1) & (fq == 1), L.TIER_LOW_ACTIVITY)
            .otherwise(L.TIER_REGULAR))
    return cs.withColumn("customer_value_tier", tier).drop("__review0")


def customer_value_tiers_top(t: Tables, n: int = 100) -> DataFrame:
    return (customer_value_tiers(t)
            .select("customer_unique_id", "customer_value_tier", "delivered_order_count", "total_payment_value",
                    "avg_payment_per_order", "first_purchase_time", "last_purchase_time")
            .orderBy(F.col("total_payment_value").desc(), "customer_unique_id").limit(n))


def _snapshot(dob: DataFrame) -> DataFrame:
    """One row, one column: the day after the last delivered purchase (time of day kept)."""
    return dob.groupBy().agg(F.timestamp_add("DAY", F.lit(1), F.max("order_purchase_timestamp")).alias("snapshot_date"))


def customer_rfm(t: Tables) -> DataFrame:
    """recency/frequency/monetary quintiles (recency 5 = most recent)."""
    dob = base.delivered_order_base(t)
    cs = base.customer_summary(t)
    rb = cs.withColumn("snapshot_date", _snapshot(dob).scalar()).select(
        "customer_unique_id",
        days_between("last_purchase_time", "snapshot_date").alias("recency_days"),
        F.col("delivered_order_count").alias("frequency_orders"),
        F.col("total_payment_value").alias("monetary_value"),
        "avg_payment_per_order", "first_purchase_time", "last_purchase_time", "snapshot_date")
    rb = stable(rb)
    rb = global_ntiles(rb, [(5, [("recency_days", False)], "recency_score"),
                            (5, [("frequency_orders", True)], "frequency_score"),
                            (5, [("monetary_value", True)], "monetary_score")], "customer_unique_id")
    r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    seg = (F.when((r >= 4) & (f >= 4) & (m >= 4), L.RFM_BEST).when((r >= 4) & (f >= 3), L.RFM_LOYAL)
           .when((r >= 4) & (m >= 4), L.RFM_RECENT_BIG).when((r <= 2) & (f >= 3), L.RFM_WIN_BACK)
           .when(r == 1, L.RFM_AT_RISK).otherwise(L.RFM_REGULAR))
    return rb.select(
        "customer_unique_id", "snapshot_date", "recency_days", "frequency_orders", "monetary_value",
        "avg_payment_per_order", "first_purchase_time", "last_purchase_time", "recency_score",
        "frequency_score", "monetary_score", (r + f + m).alias("rfm_total_score"),
        F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("rfm_code"),
        seg.alias("rfm_segment"))


def customer_rfm_top(t: Tables, n: int = 100) -> DataFrame:
    return (customer_rfm(t)
            .select("customer_unique_id", "rfm_segment", "recency_days", "frequency_orders", "monetary_value",
                    "recency_score", "frequency_score", "monetary_score", "rfm_total_score", "rfm_code")
            .orderBy(F.col("rfm_total_score").desc(), F.col("monetary_value").desc(), "customer_unique_id")
            .limit(n))


def customer_clv(t: Tables) -> DataFrame:
    """Simple 12-month CLV with the original decimal precision chain."""
    cs = base.customer_summary(t)
    life = F.col("customer_lifetime_days")
    active = (F.when(life.isNull() | (life < 30), F.lit(Decimal("1.0")).cast("decimal(18,4)"))
              .otherwise(life.cast("decimal(18,4)") / F.lit(Decimal("30.0"))))
    n4 = F.col("delivered_order_count").cast("decimal(18,4)")
    am = F.nullif(F.col("active_months"), F.lit(0))
    cb = cs.withColumn("active_months", active)
    cc = (cb.withColumn("purchase_frequency_per_month", n4 / am)
            .withColumn("estimated_monthly_value", F.col("avg_payment_per_order") * n4 / am)
            .withColumn("clv_12m_estimate", F.col("avg_payment_per_order") * n4 / am * F.lit(Decimal("12.0"))))
    cc = global_ntile(stable(cc, t.gold_dir is None), 4, [("clv_12m_estimate", True)], "customer_unique_id", "clv_quartile")
    seg = None
    for q, label in L.CLV_SEGMENTS.items():
        if q == 1:
            continue
        seg = F.when(F.col("clv_quartile") == q, label) if seg is None else seg.when(F.col("clv_quartile") == q, label)
    seg = seg.otherwise(L.CLV_SEGMENTS[1])
    return cc.select(
        "customer_unique_id", "delivered_order_count", "total_payment_value", "avg_payment_per_order",
        "first_purchase_time", "last_purchase_time", "customer_lifetime_days", "active_months",
        "purchase_frequency_per_month", "estimated_monthly_value", "clv_12m_estimate", "clv_quartile",
        seg.alias("clv_segment"))


def customer_clv_top(t: Tables, n: int = 100) -> DataFrame:
    return (customer_clv(t)
            .select("customer_unique_id", "clv_segment", "delivered_order_count", "total_payment_value",
                    "avg_payment_per_order", "active_months", "clv_12m_estimate")
            .orderBy(F.col("clv_12m_estimate").desc_nulls_last(), "customer_unique_id").limit(n))


def customer_churn(t: Tables) -> DataFrame:
    """Days since the last order vs the snapshot date (90 and 180 are 'risk')."""
    dob = base.delivered_order_base(t)
    cs = base.customer_summary(t).withColumn("snapshot_date", _snapshot(dob).scalar())
    days = days_between("last_purchase_time", "snapshot_date")
    status = (F.when(days > 180, L.CHURN_LOST).when(days.between(90, 180), L.CHURN_RISK)
              .otherwise(L.CHURN_ACTIVE))
    return cs.select("customer_unique_id", "delivered_order_count", "total_payment_value",
                     "first_purchase_time", "last_purchase_time", "snapshot_date",
                     days.alias("days_since_last_order"), status.alias("churn_status"))


def churn_summary(t: Tables) -> DataFrame:
    """B11."""
    return (customer_churn(t).groupBy("churn_status").agg(
        F.count("*").alias("customer_count"),
        F.sum("total_payment_value").alias("total_payment_value"),
        avg6("days_since_last_order").alias("avg_days_since_last_order"))
        .orderBy(F.col("customer_count").desc(), "churn_status"))


def region_delivery_insight(t: Tables) -> DataFrame:
    """B12."""
    return (base.delivered_order_base(t).groupBy(F.col("customer_state").alias("customer_region")).agg(
        F.count("*").alias("delivered_order_count"),
        F.countDistinct("customer_unique_id").alias("buyer_count"),
        F.sum("total_payment_value").alias("total_payment_value"),
        F.sum("product_gmv").alias("product_gmv"),
        avg6("purchase_to_delivery_days").alias("avg_delivery_days"),
        avg6("delivery_delay_days").alias("avg_delay_days"),
        avg6("late_delivery_flag").alias("late_delivery_rate"),
        avg6(base.review2("avg_review_score"), 2).alias("avg_review_score")))


def region_delivery_listing(t: Tables) -> DataFrame:
    return (region_delivery_insight(t).drop("product_gmv")
            .orderBy(F.col("late_delivery_rate").desc(), F.col("delivered_order_count").desc(), "customer_region"))


def seller_category_delivery_risk(t: Tables) -> DataFrame:
    """Distinct order x seller x category rows (late by *timestamp*, R6), then averaged."""
    d = _delivered_items_categorised(t, ["customer_state"]).where(
        F.col("order_delivered_customer_date").isNotNull() & F.col("order_estimated_delivery_date").isNotNull())
    s = t.sellers.select("seller_id", "seller_state")
    osc = (d.join(s, "seller_id", "left").select(
        "order_id", "seller_id", "product_category_name", "product_category_name_english", "seller_state",
        "customer_state",
        days_between("order_purchase_timestamp", "order_delivered_customer_date").alias("delivery_days"),
        days_between("order_estimated_delivery_date", "order_delivered_customer_date").alias("delay_days"),
        F.when(F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"), 1)
         .otherwise(0).alias("late_delivery_flag")).distinct())
    return osc.groupBy("seller_id", "seller_state", "customer_state", "product_category_name",
                       "product_category_name_english").agg(
        F.count("*").alias("delivered_order_count"),
        avg6("delivery_days").alias("avg_delivery_days"),
        avg6("delay_days").alias("avg_delay_days"),
        avg6("late_delivery_flag").alias("late_delivery_rate"))


def seller_category_risk_top(t: Tables, min_orders: int = 20, n: int = 100) -> DataFrame:
    return (seller_category_delivery_risk(t).where(F.col("delivered_order_count") >= min_orders)
            .orderBy(F.col("late_delivery_rate").desc(), F.col("avg_delay_days").desc(),
                     F.col("delivered_order_count").desc(), "seller_id", "customer_state", "product_category_name")
            .select("seller_id", "seller_state", "customer_state", "product_category_name_english",
                    "delivered_order_count", "avg_delivery_days", "avg_delay_days", "late_delivery_rate")
            .limit(n))


def _category_labels(t: Tables, side: str) -> DataFrame:
    p = t.products.select("product_id", "product_category_name")
    return (p.join(t.category_translation, "product_category_name", "left").select(
        F.col("product_id").alias(f"product_{side}"),
        F.coalesce("product_category_name", F.lit(L.UNKNOWN)).alias(f"product_{side}_category_name"),
        F.coalesce("product_category_name_english", "product_category_name", F.lit(L.UNKNOWN))
        .alias(f"product_{side}_category_name_english")))


def cross_sell_product_pairs(t: Tables, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Unordered product pairs bought in the same delivered order.

    Baskets are de-duplicated first; pairs come from an equi-join on
    order_id with the residual ``a < b`` (no cross join), where a basket
    larger than a chunk is split into chunk-pair join keys so no single task
    gets a hot basket's quadratic work (``functions.pairs``).  Pairs are
    counted by id and only then joined to the product dimensions.
    """
    delivered = t.orders.where(F.col("order_status") == "delivered").select("order_id")
    op = t.order_items.select("order_id", "product_id").join(delivered, "order_id", "left_semi")
    pairs = pair_counts(op, "order_id", "product_id", "product_a", "product_b", "co_purchase_order_count",
                        chunk=chunk)
    return (pairs.join(_category_labels(t, "a"), "product_a", "left")
            .join(_category_labels(t, "b"), "product_b", "left")
            .select("product_a",
                    F.coalesce("product_a_category_name", F.lit(L.UNKNOWN)).alias("product_a_category_name"),
                    F.coalesce("product_a_category_name_english", F.lit(L.UNKNOWN)).alias("product_a_category_name_english"),
                    "product_b",
                    F.coalesce("product_b_category_name", F.lit(L.UNKNOWN)).alias("product_b_category_name"),
                    F.coalesce("product_b_category_name_english", F.lit(L.UNKNOWN)).alias("product_b_category_name_english"),
                    "co_purchase_order_count"))


def cross_sell_product_top(t: Tables, n: int = 100) -> DataFrame:
    return (cross_sell_product_pairs(t)
            .select("product_a", "product_a_category_name_english", "product_b", "product_b_category_name_english",
                    "co_purchase_order_count")
            .orderBy(F.col("co_purchase_order_count").desc(), "product_a", "product_b").limit(n))


def cross_sell_category_pairs(t: Tables) -> DataFrame:
    """Category pairs per delivered order.

    A basket has at most one row per category, so it stays small and a plain self-join will do.
    Orders are dealt to tasks of like size, in which the rows are made distinct and joined.
    """
    oc = _delivered_items_categorised(t).select("order_id", F.col("product_category_name_english").alias("category_a"))
    oc = dealt(oc, t.order_items.count(), "order_id").distinct()
    return (oc.join(oc.withColumnRenamed("category_a", "category_b"), "order_id").where("category_a < category_b")
            .groupBy("category_a", "category_b").agg(F.count("*").alias("co_purchase_order_count")))


def cross_sell_category_top(t: Tables, n: int = 100) -> DataFrame:
    return (cross_sell_category_pairs(t)
            .orderBy(F.col("co_purchase_order_count").desc(), "category_a", "category_b").limit(n))


def seller_retention(t: Tables) -> DataFrame:
    """Per seller, persons served, returning (>1 order) and long-term (>= 90 days).

    (order, seller) is unique in V06, so orders are counted without a distinct.  The seller's
    place is joined to the finished seller rows, after map-side sums, so a seller with very
    many customers is no join key of many rows.
    """
    served = base.seller_order_analysis(t).where(F.col("customer_unique_id").isNotNull())
    scs = served.groupBy("seller_id", "customer_unique_id").agg(
        F.count("*").alias("delivered_order_count"),
        days_between(F.min("order_purchase_timestamp"), F.max("order_purchase_timestamp")).alias("retention_days"))
    ret = F.sum(F.when(F.col("delivered_order_count") > 1, 1).otherwise(0))
    lng = F.sum(F.when(F.col("retention_days") >= 90, 1).otherwise(0))
    by_seller = scs.groupBy("seller_id").agg(
        F.count("*").alias("total_customers"),
        ret.alias("returning_customers"),
        lng.alias("long_term_retained_customers"),
        share_pct(ret, F.count("*")).alias("returning_customer_rate_percent"),
        share_pct(lng, F.count("*")).alias("long_term_retention_rate_percent"),
        avg6("delivered_order_count").alias("avg_orders_per_customer"),
        avg6("retention_days").alias("avg_retention_days"))
    return (by_seller.join(t.sellers.select("seller_id", "seller_state", "seller_city"), "seller_id", "left")
            .select("seller_id", "seller_state", "seller_city", *[c for c in by_seller.columns if c != "seller_id"]))


def seller_retention_top(t: Tables, min_customers: int = 20, n: int = 100) -> DataFrame:
    return (seller_retention(t).where(F.col("total_customers") >= min_customers)
            .orderBy(F.col("returning_customer_rate_percent").desc(), F.col("long_term_retention_rate_percent").desc(),
                     F.col("total_customers").desc(), "seller_id")
            .drop("avg_retention_days").limit(n))


def monthly_forecast_simple(t: Tables) -> DataFrame:
    """LAG and a 3-row moving average over existing month rows."""
    m = monthly_business_trend(t).select(
        "order_month_start", (F.year("order_month_start") * 12 + F.month("order_month_start")).alias("month_index"),
        "delivered_order_count", "total_payment_value", "product_gmv")
    w = Window.orderBy("month_index")
    w3 = w.rowsBetween(-2, Window.currentRow)
    mov = lambda c: F.round(F.sum(c).over(w3) / F.count(c).over(w3), 2).cast("decimal(38,2)")
    mw = (m.withColumn("previous_month_payment_value", F.lag("total_payment_value").over(w))
           .withColumn("previous_month_product_gmv", F.lag("product_gmv").over(w))
           .withColumn("moving_avg_payment_3m", mov("total_payment_value"))
           .withColumn("moving_avg_product_gmv_3m", mov("product_gmv")))
    pay, ppay = F.col("total_payment_value"), F.col("previous_month_payment_value")
    gmv, pgmv = F.col("product_gmv"), F.col("previous_month_product_gmv")
    return mw.select(
        "order_month_start", "delivered_order_count", "total_payment_value", "previous_month_payment_value",
        (pay - ppay).alias("month_over_month_payment_change"),
        growth_pct("total_payment_value", "previous_month_payment_value").alias("month_over_month_payment_rate_percent"),
        "moving_avg_payment_3m",
        F.when(ppay.isNull(), F.lit(None)).otherwise(pay + (pay - ppay)).alias("simple_next_month_payment_forecast"),
        "product_gmv", "previous_month_product_gmv",
        (gmv - pgmv).alias("month_over_month_product_gmv_change"),
        "moving_avg_product_gmv_3m",
        F.when(pgmv.isNull(), F.lit(None)).otherwise(gmv + (gmv - pgmv)).alias("simple_next_month_product_gmv_forecast"))
