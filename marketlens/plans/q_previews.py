"""Previews of views (D18): the first rows of views that are registered in full."""

from __future__ import annotations

from marketlens.operators import base, explore, insight, lookup
from marketlens.plans.registry import ORACLE, register

VIEWS = {
    "geolocation_zip_prefix": base.geolocation_zip_prefix,
    "order_payment": base.order_payment,
    "order_item_summary": base.order_item_summary,
    "order_review_score": base.order_review_score,
    "product_sales_summary": lookup.product_sales_summary,
    "kpi_snapshot": insight.kpi_snapshot,
    "monthly_business_trend": insight.monthly_business_trend,
    "customer_rfm": insight.customer_rfm,
    "customer_clv": insight.customer_clv,
    "region_delivery_insight": insight.region_delivery_insight,
    "cross_sell_category_pairs": insight.cross_sell_category_pairs,
    "seller_retention": insight.seller_retention,
}

for _name, _view in VIEWS.items():
    _order = ", ".join(f"{c} NULLS LAST" if c.endswith(" desc") else c for c in explore.VIEW_PREVIEW_ORDER[_name])
    register(f"view_preview_{_name}", f"SELECT * FROM ({ORACLE[_name]}) v ORDER BY {_order} LIMIT 10")(
        lambda t, view=_view, name=_name: explore.view_preview(view(t), name))
