"""Publish the shared views under their original names as temporary views,
so users of the original SQL can keep querying them with ``spark.sql``.

``createOrReplaceTempView`` is the drop-and-rebuild of a named view.
"""

from __future__ import annotations

from marketlens.operators import base, insight, integrity, lookup
from marketlens.sources.catalog import Tables

# The original view names.
VIEWS = {
    "v_geolocation_zip_prefix": base.geolocation_zip_prefix,
    "v_phase3_order_payment": base.order_payment,
    "v_phase3_order_item_summary": base.order_item_summary,
    "v_phase3_order_review_score": base.order_review_score,
    "v_phase3_delivered_order_base": base.delivered_order_base,
    "v_phase3_order_seller_base": base.order_seller_base,
    "v_phase3_seller_order_analysis": base.seller_order_analysis,
    "v_phase3_monthly_business": base.monthly_business,
    "v_phase3_customer_summary": base.customer_summary,
    "v_phase3_seller_summary": base.seller_summary,
    "v_phase3_logistics_state_flow": base.logistics_state_flow,
    "v_phase4_data_quality_report": integrity.data_quality_report,
    "v_phase4_product_sales_summary": lookup.product_sales_summary,
    "v_phase5_kpi_snapshot": insight.kpi_snapshot,
    "v_phase5_category_seller_region_gmv": insight.category_seller_region_gmv,
    "v_phase5_monthly_category_gmv": insight.monthly_category_gmv,
    "v_phase5_monthly_business_trend": insight.monthly_business_trend,
    "v_phase5_yoy_growth": insight.yoy_growth,
    "v_phase5_weekday_vs_weekend": insight.weekday_vs_weekend,
    "v_phase5_customer_value_tiers": insight.customer_value_tiers,
    "v_phase5_customer_rfm": insight.customer_rfm,
    "v_phase5_customer_clv": insight.customer_clv,
    "v_phase5_customer_churn": insight.customer_churn,
    "v_phase5_region_delivery_insight": insight.region_delivery_insight,
    "v_phase5_seller_category_delivery_risk": insight.seller_category_delivery_risk,
    "v_phase5_cross_sell_product_pairs": insight.cross_sell_product_pairs,
    "v_phase5_cross_sell_category_pairs": insight.cross_sell_category_pairs,
    "v_phase5_seller_retention": insight.seller_retention,
    "v_phase5_monthly_forecast_simple": insight.monthly_forecast_simple,
}

TABLE_NAMES = {
    "customers": "customers", "orders": "orders", "order_items": "order_items",
    "order_payments": "order_payments", "order_reviews": "order_reviews", "products": "products",
    "sellers": "sellers", "category_translation": "product_category_name_translation",
    "geolocation": "geolocation",
}


def publish(t: Tables, names: list[str] | None = None) -> list[str]:
    """Register base tables and views (lazily defined) as temporary views."""
    for src, name in TABLE_NAMES.items():
        t[src].createOrReplaceTempView(name)
    done = []
    for name, fn in VIEWS.items():
        if names is None or name in names:
            fn(t).createOrReplaceTempView(name)
            done.append(name)
    return done


def _required(function: str, argument: str) -> str:
    """The argument, checked where the query runs: NULL or blanks are an error."""
    value = f"{function}.{argument}"
    return f"CASE WHEN trim(coalesce({value}, '')) = '' THEN raise_error('{argument} is required') ELSE {value} END"


#: Lookups as SQL table functions over the published names: (name, arguments, body).
FUNCTIONS = [
    ("customer_order_history", "customer_unique_id STRING", f"""
WITH person AS (SELECT * FROM customers WHERE customers.customer_unique_id = {_required('customer_order_history', 'customer_unique_id')}),
     own AS (SELECT person.*, o.* EXCEPT (customer_id) FROM person JOIN orders o ON o.customer_id = person.customer_id),
     paid AS (SELECT * FROM v_phase3_order_payment WHERE order_id IN (SELECT order_id FROM own)),
     bought AS (SELECT * FROM order_items WHERE order_id IN (SELECT order_id FROM own))
SELECT own.customer_unique_id, own.customer_id, own.customer_city, own.customer_state, own.order_id, own.order_status,
       own.order_purchase_timestamp, own.order_approved_at, own.order_delivered_customer_date, own.order_estimated_delivery_date,
       payment_record_count, payment_type_count, max_payment_installments, total_payment_value,
       order_item_id AS item_sequence_in_order, bought.product_id, p.product_category_name, product_category_name_english,
       seller_id, price, freight_value, shipping_limit_date
FROM own LEFT JOIN paid ON paid.order_id = own.order_id LEFT JOIN bought ON bought.order_id = own.order_id
     LEFT JOIN products p ON p.product_id = bought.product_id
     LEFT JOIN product_category_name_translation n ON n.product_category_name = p.product_category_name"""),
    ("seller_performance", "seller_id STRING", f"""
SELECT s.*, seller_product_gmv / nullif(CAST(delivered_order_count AS DECIMAL(18,2)), 0) AS avg_product_gmv_per_delivered_order
FROM v_phase3_seller_summary s WHERE s.seller_id = {_required('seller_performance', 'seller_id')}"""),
]


def publish_functions(t: Tables) -> list[str]:
    """Register the lookups as table functions, so that SQL users call them with named arguments:

    ``SELECT * FROM customer_order_history(customer_unique_id => '...')``.  A function does not
    order its rows.  The tables and views that they read are published with them.
    """
    publish(t, ["v_phase3_order_payment", "v_phase3_seller_summary"])
    for name, arguments, body in FUNCTIONS:
        t.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE RETURN {body}")
    return [name for name, _, _ in FUNCTIONS]


__all__ = ["FUNCTIONS", "TABLE_NAMES", "VIEWS", "publish", "publish_functions"]
