"""Hand-built silver rows covering the edge cases of FIXTURES.md section 3,
with expected values worked out by hand."""

import datetime as dt
from decimal import Decimal as D

import pytest

from marketlens.operators import analysis, base, insight
from marketlens.sources import schemas
from marketlens.sources.catalog import Tables

T = dt.datetime


@pytest.fixture(scope="module")
def edge(spark):
    def frame(name, rows):
        return spark.createDataFrame(rows, schemas.silver_schema(name))

    customers = frame("customers", [
        ("c1", "p1", "01000", "a", "SP"), ("c2", "p1", "01000", "a", "SP"),
        ("c3", "p2", "02000", "b", "RJ"), ("c4", "p3", "02000", "b", "RJ"),
    ])
    orders = frame("orders", [
        # o1: 2 payments x 3 items, delivered on the estimated day at a later hour (late by time, not by day)
        ("o1", "c1", "delivered", T(2018, 1, 1, 23, 59), T(2018, 1, 2), T(2018, 1, 3), T(2018, 1, 20, 15), T(2018, 1, 20)),
        # o2: delivered without payment, items or review; delivered 00:01 the day after purchase at 23:59
        ("o2", "c2", "delivered", T(2018, 3, 10, 23, 59), None, None, T(2018, 3, 11, 0, 1), T(2018, 3, 30)),
        # o3: two reviews -> average of the two, late by day
        ("o3", "c3", "delivered", T(2018, 6, 5, 10), T(2018, 6, 5, 11), T(2018, 6, 6), T(2018, 6, 30), T(2018, 6, 25)),
        ("o4", "c4", "shipped", T(2018, 6, 6, 10), None, None, None, T(2018, 6, 26)),
    ])
    items = frame("order_items", [
        ("o1", 1, "pa", "s1", T(2018, 1, 5), D("10.00"), D("1.00")),
        ("o1", 2, "pb", "s1", T(2018, 1, 5), D("20.00"), D("1.00")),
        ("o1", 3, "pa", "s2", T(2018, 1, 5), None, D("2.00")),
        ("o3", 1, "pb", "s2", T(2018, 6, 7), D("50.00"), D("5.00")),
    ])
    payments = frame("order_payments", [
        ("o1", 1, "credit_card", 3, D("30.00")), ("o1", 2, "voucher", 1, D("4.00")),
        ("o3", 1, "boleto", 1, D("55.00")),
    ])
    reviews = frame("order_reviews", [
        ("r1", "o1", 4, None, None, T(2018, 1, 21), T(2018, 1, 22)),
        ("r3", "o3", 5, None, None, T(2018, 7, 1), T(2018, 7, 2)),
        ("r4", "o3", 2, None, None, T(2018, 7, 1), T(2018, 7, 2)),
    ])
    products = frame("products", [("pa", "cama", 1, 1, 1, 1, 1, 1, 1), ("pb", None, 1, 1, 1, 1, 1, 1, 1)])
    translation = frame("category_translation", [("cama", "bed")])
    sellers = frame("sellers", [("s1", "01000", "a", "SP"), ("s2", "02000", "b", "RJ")])
    geo = frame("geolocation", [("01000", D("-23.5"), D("-46.6"), "a", "SP"), ("02000", D("-22.9"), D("-43.2"), "b", "RJ")])
    return Tables(spark, {"customers": customers, "orders": orders, "order_items": items,
                          "order_payments": payments, "order_reviews": reviews, "products": products,
                          "category_translation": translation, "sellers": sellers, "geolocation": geo})


def test_delivered_base_zero_vs_null(edge):
    rows = {r.order_id: r for r in base.delivered_order_base(edge).collect()}
    assert set(rows) == {"o1", "o2", "o3"}
    o2 = rows["o2"]
    assert (o2.total_payment_value, o2.item_row_count, o2.product_gmv) == (0, 0, 0)
    assert o2.avg_review_score is None and o2.review_row_count is None
    assert o2.purchase_to_delivery_days == 1                       # midnights crossed
    o1 = rows["o1"]
    assert o1.late_delivery_flag == 0                              # same day, later hour
    assert o1.product_gmv == D("30.00") and o1.item_total_value == D("34.00")   # NULL price counts as 0
    assert o1.product_count == 2 and o1.seller_count == 2
    assert rows["o3"].avg_review_score == D("3.500000") and rows["o3"].late_delivery_flag == 1


def test_fanout_audit(edge):
    r = analysis.payment_fanout_audit(edge).first()
    assert r.correct_total_payment == D("89.00")
    assert r.wrong_total_payment_after_join == D("34.00") * 3 + D("55.00")
    assert r.wrong_to_correct_ratio == D("1.7640")


def test_late_by_time_in_review_comparison(edge):
    from marketlens.operators import explore
    rows = {r.delayed_flag: r for r in explore.review_score_by_delay(edge).collect()}
    from marketlens.functions.labels import DELAYED
    # o1 is late by timestamp (15:00 > 00:00) and o3 is late: both reviewed
    assert rows[DELAYED].reviewed_order_count == 2
    assert rows[DELAYED].avg_review_score == D("3.750000")        # (4 + 3.5) / 2


def test_category_labels_and_nulls(edge):
    pairs = insight.cross_sell_product_pairs(edge).collect()
    assert len(pairs) == 1
    p = pairs[0]
    assert (p.product_a, p.product_b, p.co_purchase_order_count) == ("pa", "pb", 1)
    assert p.product_a_category_name_english == "bed" and p.product_b_category_name_english == "unknown"


def test_product_sales_keeps_unknown_price(edge):
    from marketlens.operators import lookup
    rows = {r.product_id: r for r in lookup.product_sales_summary(edge).collect()}
    assert rows["pa"].price_missing_row_count == 1 and rows["pa"].product_gmv_known_price_only == D("10.00")


def test_growth_null_after_missing_previous(edge):
    rows = insight.monthly_forecast_simple(edge).orderBy("order_month_start").collect()
    assert [r.order_month_start.month for r in rows] == [1, 3, 6]   # missing months are not filled
    assert rows[0].previous_month_payment_value is None and rows[0].simple_next_month_payment_forecast is None
    assert rows[1].previous_month_payment_value == D("34.00")
    assert rows[1].month_over_month_payment_rate_percent == D("-100.00")
    assert rows[2].month_over_month_payment_rate_percent is None     # previous month paid 0
    assert rows[2].moving_avg_payment_3m == D("29.67")               # (34 + 0 + 55) / 3


def test_distance_identical_points_and_bands(edge):
    rows = analysis.distance_band_delivery(edge).collect()
    assert sum(r.seller_order_count for r in rows) == 3
    assert rows[0].distance_band == "0-99 km" and rows[0].avg_estimated_distance_km == D("0.000000")


def test_orders_without_a_known_centroid_have_no_distance(edge, spark):
    rows = [("01000", D("-23.5"), D("-46.6"), "a", "SP"), ("02000", None, D("-43.2"), "b", "RJ")]
    known = edge.with_frames(geolocation=spark.createDataFrame(rows, schemas.silver_schema("geolocation")))
    got = analysis.distance_band_delivery(known).collect()
    # only o1 from s1 has both centroids: o1 from s2 and o3 touch the prefix without a latitude
    assert [(r.distance_band, r.seller_order_count) for r in got] == [("0-99 km", 1)]


def test_retention_by_hand(edge):
    rows = {r.seller_id: r for r in insight.seller_retention(edge).collect()}
    assert (rows["s1"].total_customers, rows["s1"].returning_customers, rows["s1"].seller_state) == (1, 0, "SP")
    assert (rows["s2"].total_customers, rows["s2"].long_term_retained_customers, rows["s2"].avg_retention_days) == (2, 0, 0)


def test_category_risk_by_hand(edge):
    rows = {(r.seller_id, r.product_category_name_english): r for r in insight.seller_category_delivery_risk(edge).collect()}
    assert rows[("s1", "bed")].late_delivery_rate == 1           # late by timestamp, on the estimated day
    assert rows[("s1", "bed")].avg_delay_days == 0 and rows[("s2", "unknown")].avg_delay_days == 5
    assert sum(r.delivered_order_count for r in rows.values()) == 4


def test_constraints_by_hand(edge):
    from marketlens.operators import integrity
    rows = integrity.constraint_status(edge).collect()
    assert len(rows) == 9 and all(r.violation_count == 0 and r.enforceable == 1 for r in rows)


def test_churn_and_clv_edges(edge):
    churn = {r.customer_unique_id: r for r in insight.customer_churn(edge).collect()}
    # snapshot = last purchase (2018-06-05 10:00) + 1 day
    assert churn["p2"].days_since_last_order == 1
    assert churn["p1"].days_since_last_order == 88             # 2018-03-10 -> 2018-06-06
    clv = {r.customer_unique_id: r for r in insight.customer_clv(edge).collect()}
    assert clv["p1"].customer_lifetime_days == 68 and clv["p1"].active_months == D("2.26666667")
    assert clv["p2"].active_months == D("1.00000000")
