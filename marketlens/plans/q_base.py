"""Registered queries for the shared views."""

from __future__ import annotations

from marketlens.operators import base
from marketlens.plans.oracle_base import LIB
from marketlens.plans.registry import register

_VIEWS = {
    "geolocation_zip_prefix": (base.geolocation_zip_prefix, "v_geo_zip"),
    "order_payment": (base.order_payment, "v_order_payment"),
    "order_item_summary": (base.order_item_summary, "v_order_item_summary"),
    "order_review_score": (base.order_review_score, "v_order_review_score"),
    "delivered_order_base": (base.delivered_order_base, "v_delivered_order_base"),
    "order_seller_base": (base.order_seller_base, "v_order_seller_base"),
    "seller_order_analysis": (base.seller_order_analysis, "v_seller_order_analysis"),
    "monthly_business": (base.monthly_business, "v_monthly_business"),
    "customer_summary": (base.customer_summary, "v_customer_summary"),
    "seller_summary": (base.seller_summary, "v_seller_summary"),
    "logistics_state_flow": (base.logistics_state_flow, "v_logistics_state_flow"),
}

for _key, (_fn, _cte) in _VIEWS.items():
    register(_key, LIB.build(f"SELECT * FROM {_cte}"))(_fn)
