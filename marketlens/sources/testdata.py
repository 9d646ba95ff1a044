"""Stand-in mapping from the driver's TPC-H-like test tables to the nine
silver tables (FIXTURES.md section 4).

Everything is a deterministic function of the source keys so that the SQL
oracle can derive identical rows.  All arithmetic is integer or decimal.
The constants below are fixed values of the stand-in data model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Order status codes and payment types of the stand-in data.
STATUS_BY_CODE = {"F": "delivered", "O": "shipped", "P": "processing"}
PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card"]
SCORE_BY_EVENT = {"purchase": 5, "view": 4, "click": 3, "signup": 2, "error": 1}
UNTRANSLATED_CATEGORY = "small"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _zip(c: Column) -> Column:
    return F.right(F.concat(F.lit("00000"), c.cast("string")), F.lit(5))


def _hours(ts: Column, n: Column) -> Column:
    return F.timestamp_add("HOUR", n.cast("int"), ts)


def _days(ts: Column, n: Column) -> Column:
    return F.timestamp_add("DAY", n.cast("int"), ts)


def _case(c: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def orders(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pt = _hours(F.col("o_orderdate"), k % 24)
    code = F.col("o_orderstatus")
    return o.select(
        _id("o", k).alias("order_id"),
        _id("o", k).alias("customer_id"),
        _case(code, STATUS_BY_CODE).alias("order_status"),
        pt.alias("order_purchase_timestamp"),
        F.when(k % 97 == 0, F.lit(None))
         .when(k % 89 == 0, _hours(pt, F.lit(-1)))
         .otherwise(_days(pt, k % 3)).alias("order_approved_at"),
        F.when((code == "P") | (k % 83 == 0), F.lit(None))
         .otherwise(_days(pt, 2 + k % 4)).alias("order_delivered_carrier_date"),
        F.when((code != "F") | (k % 101 == 0), F.lit(None))
         .when(k % 499 == 0, _days(pt, F.lit(-1)))
         .otherwise(_days(pt, 3 + (k * 11) % 28)).alias("order_delivered_customer_date"),
        _days(F.col("o_orderdate"), F.lit(20)).alias("order_estimated_delivery_date"),
    )


def customers(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)  # 25 rows, fixed
             .select(_id("o", F.col("o_orderkey")).alias("customer_id"),
                     _id("c", F.col("c_custkey")).alias("customer_unique_id"),
                     _zip(F.col("c_nationkey")).alias("customer_zip_code_prefix"),
                     F.lower("c_mktsegment").alias("customer_city"),
                     F.col("n_name").alias("customer_state")))


def order_items(spark, sf_dir) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    h = F.col("l_orderkey") * 7 + F.col("l_partkey")
    qty = F.col("l_quantity").cast("decimal(18,2)")
    return li.select(
        _id("o", F.col("l_orderkey")).alias("order_id"),
        F.row_number().over(w).cast("int").alias("order_item_id"),
        _id("p", F.col("l_partkey")).alias("product_id"),
        _id("s", F.col("l_suppkey")).alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.when(h % 211 == 0, F.lit(None).cast("decimal(18,2)"))
         .otherwise(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"),
        F.when(h % 1009 == 0, -qty).otherwise(qty).alias("freight_value"),
    )


def order_payments(spark, sf_dir) -> DataFrame:
    o = _read(spark, sf_dir, "orders").where(F.col("o_orderkey") % 301 != 0)
    k = F.col("o_orderkey")
    seq = F.col("payment_sequential")
    exploded = o.select("o_orderkey", "o_totalprice",
                        F.explode(F.sequence(F.lit(1), (1 + k % 3).cast("int"))).alias("payment_sequential"))
    first = (F.col("o_totalprice").cast("decimal(18,2)") - F.lit(100) * (k % 3)).cast("decimal(18,2)")
    ptype = None
    for i, name in enumerate(PAYMENT_TYPES):
        cond = (k + seq) % len(PAYMENT_TYPES) == i
        ptype = F.when(cond, F.lit(name)) if ptype is None else ptype.when(cond, F.lit(name))
    return exploded.select(
        _id("o", k).alias("order_id"),
        seq.cast("int").alias("payment_sequential"),
        ptype.alias("payment_type"),
        (1 + k % 12).cast("int").alias("payment_installments"),
        F.when((k + seq) % 401 == 0, F.lit(None).cast("decimal(18,2)"))
         .when(seq == 1, first)
         .otherwise(F.lit(100).cast("decimal(18,2)")).alias("payment_value"),
    )


def order_reviews(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    eid = F.col("event_id")
    ts = F.col("ts")
    # whole seconds, built from the wall-clock fields (no session time zone involved)
    created = F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts))
    return e.select(
        _id("r", eid - F.when(eid % 50 == 1, 1).otherwise(0)).alias("review_id"),
        _id("o", eid - F.when(eid % 5 == 4, 1).otherwise(0)).alias("order_id"),
        F.when(eid % 103 == 0, F.lit(None).cast("int"))
         .otherwise(_case(F.col("event_type"), SCORE_BY_EVENT)).cast("int").alias("review_score"),
        F.col("event_type").alias("review_comment_title"),
        F.col("props").alias("review_comment_message"),
        created.alias("review_creation_date"),
        _days(created, F.lit(1)).alias("review_answer_timestamp"),
    )


def products(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        _id("p", F.col("p_partkey")).alias("product_id"),
        F.when(F.col("p_partkey") % 50 == 0, F.lit(None).cast("string"))
         .otherwise(F.lower("p_type")).alias("product_category_name"),
        F.length("p_name").cast("int").alias("product_name_lenght"),
        F.length(F.concat_ws(" ", "p_name", "p_brand", "p_type")).cast("int").alias("product_description_lenght"),
        (1 + F.col("p_size") % 4).cast("int").alias("product_photos_qty"),
        (F.col("p_size") * 100).cast("int").alias("product_weight_g"),
        F.col("p_size").cast("int").alias("product_length_cm"),
        F.col("p_size").cast("int").alias("product_height_cm"),
        F.col("p_size").cast("int").alias("product_width_cm"),
    )


def category_translation(spark, sf_dir) -> DataFrame:
    cat = F.lower("p_type")
    return (_read(spark, sf_dir, "part").select(cat.alias("product_category_name")).distinct()
            .where(F.col("product_category_name") != UNTRANSLATED_CATEGORY)
            .select("product_category_name",
                    F.concat(F.lit("en_"), "product_category_name").alias("product_category_name_english")))


def sellers(spark, sf_dir) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
             .select(_id("s", F.col("s_suppkey")).alias("seller_id"),
                     _zip(F.col("s_nationkey")).alias("seller_zip_code_prefix"),
                     F.lower("n_name").alias("seller_city"),
                     F.col("n_name").alias("seller_state")))


def geolocation(spark, sf_dir) -> DataFrame:
    c = _read(spark, sf_dir, "customer").where(F.col("c_nationkey") != 24)
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nk, ck = F.col("c_nationkey"), F.col("c_custkey")
    lat = (nk - 12).cast("decimal(20,0)") + (ck % 100).cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)")
    lng = (nk - 60).cast("decimal(20,0)") + (ck % 90).cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
             .select(_zip(nk).alias("geolocation_zip_code_prefix"),
                     lat.cast("decimal(18,15)").alias("geolocation_lat"),
                     lng.cast("decimal(18,15)").alias("geolocation_lng"),
                     F.lower("c_mktsegment").alias("geolocation_city"),
                     F.col("n_name").alias("geolocation_state")))


BUILDERS = {
    "customers": customers, "category_translation": category_translation,
    "sellers": sellers, "products": products, "orders": orders,
    "order_items": order_items, "order_payments": order_payments,
    "order_reviews": order_reviews, "geolocation": geolocation,
}
