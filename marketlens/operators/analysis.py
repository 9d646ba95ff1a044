"""Advanced analysis on the delivered-order views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import labels as L
from marketlens.functions.columns import avg6, category_label, msum
from marketlens.functions.geo import great_circle_km
from marketlens.functions.ranking import global_ntiles, global_rank, running_sum, stable
from marketlens.operators import base
from marketlens.sources.catalog import Tables



def delivered_order_preview(t: Tables, n: int = 20) -> DataFrame:
    """A01."""
    return (base.delivered_order_base(t)
            .select("order_id", "customer_unique_id", "order_purchase_timestamp", "total_payment_value",
                    "product_gmv", "freight_value", "item_row_count", "seller_count", "avg_review_score",
                    "purchase_to_delivery_days", "late_delivery_flag")
            .orderBy("order_purchase_timestamp", "order_id").limit(n))


def duplicate_order_grain(t: Tables) -> DataFrame:
    """Order ids appearing more than once in V04 (expected 0)."""
    dup = base.delivered_order_base(t).groupBy("order_id").count().where(F.col("count") > 1)
    return dup.groupBy().agg(F.count("*").alias("duplicate_order_id_count"))


def payment_fanout_audit(t: Tables) -> DataFrame:
    """The correct payment total vs the total after a payments x items join.

    The wrong total is computed *without* materialising the fan-out: each
    payment row is repeated once per item row of its order, so its
    contribution is value x item count, aggregated per order first.
    """
    correct = base.delivered_order_base(t).groupBy().agg(F.sum("total_payment_value").alias("correct_total_payment"))
    delivered = t.orders.where(F.col("order_status") == "delivered").select("order_id")
    items = t.order_items.groupBy("order_id").agg(F.count("*").alias("n_items"))
    pays = t.order_payments.groupBy("order_id").agg(msum("payment_value").alias("pay"))
    wrong = (delivered.join(pays, "order_id").join(items, "order_id")
             .groupBy().agg(F.sum((F.col("pay") * F.col("n_items")).cast("decimal(38,2)"))
                            .alias("wrong_total_payment_after_join")))
    c, w = F.col("correct_total_payment"), F.col("wrong_total_payment_after_join")
    return correct.withColumn("wrong_total_payment_after_join", wrong.scalar()).select(
        c, w, (w - c).alias("overcount_amount"),
        (w / F.nullif(c, F.lit(0))).cast("decimal(18,4)").alias("wrong_to_correct_ratio"))


def payment_item_reconciliation(t: Tables) -> DataFrame:
    """A04."""
    return base.delivered_order_base(t).groupBy().agg(
        F.sum("total_payment_value").alias("total_payment_value"),
        F.sum("product_gmv").alias("product_gmv"),
        F.sum("freight_value").alias("freight_value"),
        F.sum("item_total_value").alias("item_total_value"),
        (F.sum("total_payment_value") - F.sum("item_total_value")).alias("payment_minus_item_total"))


def monthly_business_listing(t: Tables) -> DataFrame:
    """V07 listing ordered by month (P3 listing)."""
    return base.monthly_business(t).orderBy("order_month_start")


def monthly_cumulative(t: Tables) -> DataFrame:
    """Running totals over the month rows (at most 12 rows per year, so
    the un-partitioned window runs over a tiny aggregated input)."""
    w = Window.orderBy("order_month_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = base.monthly_business(t)
    return m.select("order_month_start", "delivered_order_count", "total_payment_value", "product_gmv",
                    F.sum("total_payment_value").over(w).alias("cumulative_payment_value"),
                    F.sum("product_gmv").over(w).alias("cumulative_product_gmv")).orderBy("order_month_start")


def customer_cumulative_payment(t: Tables, n: int | None = 200) -> DataFrame:
    """Running payment per person in purchase order.

    The report orders by person first, so its first n rows come from at most
    n persons: those are picked first (a top-k over distinct ids) and only
    their orders are summed.  The running sum itself is range-split
    (``running_sum``), so one person with a very large share of all orders
    does not end up in a single task.  ``n=None`` returns every row.
    """
    dob = base.delivered_order_base(t).where(F.col("customer_unique_id").isNotNull()).select(
        "customer_unique_id", "order_id", "order_purchase_timestamp", "total_payment_value")
    if n is not None:
        firsts = dob.select("customer_unique_id").distinct().orderBy("customer_unique_id").limit(n)
        dob = dob.join(firsts, "customer_unique_id", "left_semi")
    out = running_sum(dob, ["customer_unique_id"], [("order_purchase_timestamp", True), ("order_id", True)],
                      "total_payment_value", "cumulative_customer_payment_value")
    out = out.orderBy("customer_unique_id", "order_purchase_timestamp", "order_id")
    return out.limit(n) if n is not None else out


def orders_above_avg_items(t: Tables) -> DataFrame:
    """Orders with more item rows than the average order (an uncorrelated
    scalar subquery: evaluated once, then compared row by row)."""
    dob = base.delivered_order_base(t)
    avg = dob.groupBy().agg(avg6("item_row_count").alias("__avg_items"))
    return (dob.where(F.col("item_row_count") > avg.scalar())
            .select("order_id", "customer_unique_id", "order_purchase_timestamp", "item_row_count",
                    "product_count", "total_payment_value")
            .orderBy(F.col("item_row_count").desc(), F.col("total_payment_value").desc(), "order_id"))


def _items_with_category(t: Tables, default: str) -> DataFrame:
    p = t.products.select("product_id", "product_category_name")
    return (t.order_items.join(p, "product_id", "left")
            .join(t.category_translation, "product_category_name", "left")
            .withColumn("product_category",
                        category_label("product_category_name_english", "product_category_name", default)))


def category_summary(t: Tables) -> DataFrame:
    """Order x category grain first, then category; V04 is joined once
    (it is unique per order, so its review and late flag ride along)."""
    dob = base.delivered_order_base(t).select("order_id", "avg_review_score", "late_delivery_flag")
    ocb = (_items_with_category(t, L.UNCATEGORIZED).join(dob, "order_id")
           .groupBy("order_id", "product_category", "avg_review_score", "late_delivery_flag")
           .agg(F.count("*").alias("item_row_count"), msum("price").alias("category_product_gmv"),
                msum("freight_value").alias("category_freight_value")))
    return (ocb.groupBy("product_category").agg(
        F.count("*").alias("order_category_count"),
        F.sum("item_row_count").alias("item_row_count"),
        F.sum("category_product_gmv").alias("product_gmv"),
        F.sum("category_freight_value").alias("freight_value"),
        avg6(base.review2("avg_review_score"), 2).alias("avg_review_score"),
        avg6("late_delivery_flag").alias("late_delivery_rate"))
        .orderBy(F.col("product_gmv").desc(), "product_category"))


def products_above_avg_gmv(t: Tables, n: int = 50) -> DataFrame:
    """Product GMV (delivered orders) above the mean product GMV.

    Items are reduced to delivered ones and to product rows first; the mean is a scalar
    subquery over the same product rows, and only products above it meet their category.
    """
    delivered = t.orders.where(F.col("order_status") == "delivered").select("order_id")
    ps = (t.order_items.join(delivered, "order_id", "left_semi").groupBy("product_id").agg(
        F.countDistinct("order_id").alias("delivered_order_count"),
        F.count("*").alias("item_row_count"),
        msum("price").alias("product_gmv"), msum("freight_value").alias("freight_value")))
    avg = ps.groupBy().agg(avg6("product_gmv", 2).alias("avg_product_gmv"))
    above = ps.withColumn("avg_product_gmv", avg.scalar()).where(F.col("product_gmv") > F.col("avg_product_gmv"))
    named = (above.join(t.products.select("product_id", "product_category_name"), "product_id", "left")
             .join(t.category_translation, "product_category_name", "left"))
    label = category_label("product_category_name_english", "product_category_name", L.UNCATEGORIZED)
    return (named.select("product_id", label.alias("product_category"), "delivered_order_count", "item_row_count",
                         "product_gmv", "freight_value", "avg_product_gmv")
            .orderBy(F.col("product_gmv").desc(), "product_id").limit(n))


def customer_repeat_segments(t: Tables) -> DataFrame:
    """A10."""
    n = F.col("delivered_order_count")
    seg = (F.when(n == 1, L.REPEAT_ONCE).when(n.between(2, 3), L.REPEAT_LIGHT)
           .when(n.between(4, 6), L.REPEAT_MEDIUM).otherwise(L.REPEAT_HEAVY))
    cs = base.customer_summary(t).withColumn("customer_segment", seg)
    return (cs.groupBy("customer_segment").agg(
        F.count("*").alias("customer_count"),
        F.sum("total_payment_value").alias("total_payment_value"),
        avg6("total_payment_value", 2).alias("avg_customer_value"),
        avg6(F.col("avg_payment_per_order").cast("decimal(18,2)"), 2).alias("avg_order_payment"),
        avg6(base.review2("avg_review_score"), 2).alias("avg_review_score"),
        avg6(F.col("late_delivery_rate").cast("decimal(10,4)"), 4).alias("late_delivery_rate"))
        .orderBy(F.col("total_payment_value").desc()))


def top_customers_by_payment(t: Tables, n: int = 100) -> DataFrame:
    """V08 listing: top persons by payment (id breaks ties)."""
    return base.customer_summary(t).orderBy(F.col("total_payment_value").desc(), "customer_unique_id").limit(n)


def top_sellers_by_gmv(t: Tables, n: int = 100) -> DataFrame:
    """V09 listing: top sellers by GMV (id breaks ties)."""
    return base.seller_summary(t).orderBy(F.col("seller_product_gmv").desc(), "seller_id").limit(n)


def seller_rank(t: Tables, n: int = 200) -> DataFrame:
    """Rank in state and overall by GMV, both without a single-partition window."""
    ss = stable(base.seller_summary(t), t.gold_dir is None).select(
        "seller_id", "seller_state", "delivered_order_count", "seller_product_gmv", "avg_review_score",
        "late_delivery_rate")
    ranked = global_rank(ss, [("seller_product_gmv", False)], "rank_in_seller_state_by_gmv",
                         partition_by=["seller_state"])
    ranked = global_rank(ranked, [("seller_product_gmv", False)], "overall_rank_by_gmv")
    return ranked.orderBy("overall_rank_by_gmv", "seller_id").limit(n)


def _seller_scored(t: Tables) -> DataFrame:
    ss = (stable(base.seller_summary(t), t.gold_dir is None)
          .withColumn("__review0", F.coalesce("avg_review_score", F.lit(0)))
          .withColumn("__late0", F.coalesce("late_delivery_rate", F.lit(0))))
    ss = global_ntiles(ss, [(4, [("seller_product_gmv", True)], "revenue_quartile"),
                            (4, [("__review0", True)], "review_quartile"),
                            (4, [("__late0", True)], "late_risk_quartile")], "seller_id")
    rq, vq, lq = F.col("revenue_quartile"), F.col("review_quartile"), F.col("late_risk_quartile")
    seg = (F.when(F.col("delivered_order_count") < 5, L.SELLER_SMALL_SAMPLE)
           .when((rq == 4) & (vq >= 3) & (lq <= 2), L.SELLER_CORE)
           .when((rq == 4) & ((vq <= 2) | (lq >= 3)), L.SELLER_HIGH_RISK)
           .when((rq <= 2) & (vq == 4) & (lq <= 2), L.SELLER_REPUTATION)
           .when(lq == 4, L.SELLER_LOGISTICS)
           .otherwise(L.SELLER_STABLE))
    return ss.withColumn("seller_segment", seg).drop("__review0", "__late0")


def seller_segments(t: Tables, n: int = 200) -> DataFrame:
    """A12."""
    return (_seller_scored(t).select(
        "seller_id", "seller_state", "seller_segment", "delivered_order_count", "seller_product_gmv",
        "avg_review_score", "reviewed_order_count", "avg_delivery_days", "late_delivery_rate",
        "revenue_quartile", "review_quartile", "late_risk_quartile")
        .orderBy(F.col("seller_product_gmv").desc(), "seller_id").limit(n))


def seller_segment_summary(t: Tables) -> DataFrame:
    """A13."""
    return (_seller_scored(t).groupBy("seller_segment").agg(
        F.count("*").alias("seller_count"),
        F.sum("delivered_order_count").alias("delivered_order_count"),
        F.sum("seller_product_gmv").alias("seller_product_gmv"),
        avg6(base.review2("avg_review_score"), 2).alias("avg_review_score"),
        avg6(F.col("avg_delivery_days").cast("decimal(10,2)"), 2).alias("avg_delivery_days"),
        avg6(F.col("late_delivery_rate").cast("decimal(10,4)"), 4).alias("late_delivery_rate"))
        .orderBy(F.col("seller_product_gmv").desc()))


def top_state_flows(t: Tables, n: int = 50) -> DataFrame:
    """A14."""
    return (base.logistics_state_flow(t)
            .orderBy(F.col("delivered_order_count").desc(), F.col("seller_product_gmv").desc(),
                     "seller_state", "customer_state").limit(n))


def risky_state_flows(t: Tables, min_orders: int = 100, n: int = 50) -> DataFrame:
    """Flows with enough orders, riskiest first."""
    return (base.logistics_state_flow(t).where(F.col("delivered_order_count") >= min_orders)
            .select("seller_state", "customer_state", "delivered_order_count", "seller_product_gmv",
                    "avg_delivery_days", "avg_delay_days", "late_delivery_rate")
            .orderBy(F.col("late_delivery_rate").desc(), F.col("avg_delay_days").desc(),
                     F.col("delivered_order_count").desc(), "seller_state", "customer_state").limit(n))


def distance_band_delivery(t: Tables) -> DataFrame:
    """Great-circle km between customer and seller zip centroids, in bands.

    A row needs all four coordinates: a zip prefix without a known centroid has no
    distance and its orders are left out, as are orders of unknown prefixes.
    """
    soa = base.seller_order_analysis(t).select(
        "order_id", "seller_id", "purchase_to_delivery_days", "delivery_delay_days", "late_delivery_flag")
    cz = (t.orders.where(F.col("order_status") == "delivered").select("order_id", "customer_id")
          .join(t.customers.select("customer_id", "customer_zip_code_prefix"), "customer_id"))
    sz = t.sellers.select("seller_id", "seller_zip_code_prefix")
    geo = (base.geolocation_zip_prefix(t).select("geolocation_zip_code_prefix", "avg_geolocation_lat", "avg_geolocation_lng")
           .where(F.col("avg_geolocation_lat").isNotNull() & F.col("avg_geolocation_lng").isNotNull()))
    cg = geo.toDF("customer_zip_code_prefix", "customer_lat", "customer_lng")
    sg = geo.toDF("seller_zip_code_prefix", "seller_lat", "seller_lng")
    # the centroids meet each side at its own grain, before the order rows
    buyers = cz.join(cg, "customer_zip_code_prefix").select("order_id", "customer_lat", "customer_lng")
    sellers = sz.join(sg, "seller_zip_code_prefix").select("seller_id", "seller_lat", "seller_lng")
    d = (soa.join(buyers, "order_id").join(sellers, "seller_id")
         .withColumn("km", great_circle_km("seller_lat", "seller_lng", "customer_lat", "customer_lng")))
    band = None
    for upper, label in L.DISTANCE_BANDS:
        band = F.when(F.col("km") < upper, label) if band is None else band.when(F.col("km") < upper, label)
    band = band.otherwise(L.DISTANCE_BAND_LAST)
    return (d.withColumn("distance_band", band).groupBy("distance_band").agg(
        F.count("*").alias("seller_order_count"),
        avg6(F.col("km").cast("decimal(18,2)"), 2).alias("avg_estimated_distance_km"),
        avg6("purchase_to_delivery_days").alias("avg_delivery_days"),
        avg6("delivery_delay_days").alias("avg_delay_days"),
        avg6("late_delivery_flag").alias("late_delivery_rate"),
        F.min("km").alias("__min_km"))
        .orderBy("__min_km").drop("__min_km"))
