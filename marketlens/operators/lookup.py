"""Parameterised lookups and product summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import labels as L
from marketlens.functions.columns import category_label, msum_nullable, ordered_list
from marketlens.operators import base
from marketlens.sources.catalog import Tables



def _require(value: str | None, message: str) -> str:
    if value is None or not str(value).strip():
        raise ValueError(message)
    return value


def customer_order_history(t: Tables, customer_unique_id: str | None) -> DataFrame:
    """Every order line of one person (NULL/blank argument raises).

    The person filter is applied first; payments are semi-joined to the
    selected orders *before* they are aggregated, so only that person's
    payments are touched.
    """
    cid = _require(customer_unique_id, "customer_unique_id is required (do not look up a person by customer_id)")
    c = t.customers.where(F.col("customer_unique_id") == cid)
    o = t.orders.join(c, "customer_id")
    sel = o.select("order_id")
    pay = base.order_payment(t.with_frames(order_payments=t.order_payments.join(sel, "order_id", "left_semi")))
    items = t.order_items.join(sel, "order_id", "left_semi")
    p = t.products.select("product_id", "product_category_name")
    return (o.join(pay, "order_id", "left").join(items, "order_id", "left").join(p, "product_id", "left")
            .join(t.category_translation, "product_category_name", "left")
            .select("customer_unique_id", "customer_id", "customer_city", "customer_state", "order_id",
                    "order_status", "order_purchase_timestamp", "order_approved_at",
                    "order_delivered_customer_date", "order_estimated_delivery_date", "payment_record_count",
                    "payment_type_count", "max_payment_installments", "total_payment_value",
                    F.col("order_item_id").alias("item_sequence_in_order"), "product_id",
                    "product_category_name", "product_category_name_english", "seller_id", "price",
                    "freight_value", "shipping_limit_date")
            .orderBy(F.col("order_purchase_timestamp").desc(), "order_id", "item_sequence_in_order"))


def seller_performance(t: Tables, seller_id: str | None) -> DataFrame:
    """One seller's summary row plus GMV per delivered order."""
    sid = _require(seller_id, "seller_id is required")
    soa = base.seller_order_analysis(t).where(F.col("seller_id") == sid)
    ss = base.seller_summary(t, soa)
    avg = F.col("seller_product_gmv") / F.nullif(F.col("delivered_order_count").cast("decimal(18,2)"), F.lit(0))
    return ss.withColumn("avg_product_gmv_per_delivered_order", avg)


def sample_lookup_argument(t: Tables) -> DataFrame:
    """The arguments the procedures are smoke-tested with (top person, top seller)."""
    c = (base.customer_summary(t).orderBy(F.col("delivered_order_count").desc(), F.col("total_payment_value").desc(),
                                          "customer_unique_id").limit(1)
         .select(F.lit("customer_unique_id").alias("argument_name"), F.col("customer_unique_id").alias("argument_value")))
    s = (base.seller_summary(t).orderBy(F.col("seller_product_gmv").desc(), "seller_id").limit(1)
         .select(F.lit("seller_id").alias("argument_name"), F.col("seller_id").alias("argument_value")))
    return c.unionAll(s)


def sample_argument(t: Tables, name: str) -> str:
    """One bounded driver read (a single row) to pick the smoke-test argument."""
    row = sample_lookup_argument(t).where(F.col("argument_name") == name).first()
    return row["argument_value"] if row else None


def product_sales_summary(t: Tables) -> DataFrame:
    """Delivered product sales; price unknown stays NULL ("unknown is not 0", R9)."""
    o = t.orders.where(F.col("order_status") == "delivered").select("order_id", "order_purchase_timestamp")
    p = t.products.select("product_id", "product_category_name")
    d = (t.order_items.join(o, "order_id").join(p, "product_id", "left")
         .join(t.category_translation, "product_category_name", "left"))
    return d.groupBy("product_id", "product_category_name", "product_category_name_english").agg(
        F.count("*").alias("sold_item_row_count"),
        F.countDistinct("order_id").alias("delivered_order_count"),
        F.countDistinct("seller_id").alias("seller_count"),
        F.count("price").alias("price_known_row_count"),
        (F.count("*") - F.count("price")).alias("price_missing_row_count"),
        msum_nullable("price").alias("product_gmv_known_price_only"),
        msum_nullable("freight_value").alias("freight_value_known_only"),
        F.min("order_purchase_timestamp").alias("first_purchase_time"),
        F.max("order_purchase_timestamp").alias("last_purchase_time"))


def product_sales_top(t: Tables, n: int = 50) -> DataFrame:
    return (product_sales_summary(t)
            .orderBy(F.col("sold_item_row_count").desc(), F.col("product_gmv_known_price_only").desc_nulls_last(),
                     "product_id").limit(n))


def ordered_string_agg(t: Tables) -> DataFrame:
    """Per order, its distinct categories as one ordered, comma-separated list.

    The per-order set is bounded by the number of categories.
    """
    p = t.products.select("product_id", "product_category_name")
    d = (t.order_items.select("order_id", "product_id").join(p, "product_id", "left")
         .join(t.category_translation, "product_category_name", "left")
         .select("order_id", category_label("product_category_name_english", "product_category_name",
                                            L.UNCATEGORIZED).alias("category")))
    return d.groupBy("order_id").agg(
        F.count("*").alias("item_row_count"),
        F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("category_list"))


def category_list_by_item(t: Tables) -> DataFrame:
    """Per order, its distinct categories in the order of their first item, as one comma-separated list."""
    p = t.products.select("product_id", "product_category_name")
    d = (t.order_items.select("order_id", "product_id", "order_item_id").join(p, "product_id", "left")
         .join(t.category_translation, "product_category_name", "left")
         .select("order_id", "order_item_id", category_label("product_category_name_english", "product_category_name", L.UNCATEGORIZED).alias("category")))
    once = d.groupBy("order_id", "category").agg(F.count("*").alias("n"), F.min("order_item_id").alias("first_item"))
    return once.groupBy("order_id").agg(F.sum("n").alias("item_row_count"), ordered_list("category", "first_item", "category").alias("category_list"))
