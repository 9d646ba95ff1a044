"""Load checks, key/reference contracts and data-quality reports
(D01, D11-D16, C01-C05).

Checks that read the same table are evaluated together: one scan with
conditional counts per table instead of one scan per check, and the
``NOT EXISTS`` checks are ``left_anti`` joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import labels as L
from marketlens.sources import schemas
from marketlens.sources.catalog import Tables



def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionAll(b), frames)


def _count_if(cond) -> "F.Column":
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def staging_row_counts(spark: SparkSession, prefix: str = "stg_") -> DataFrame:
    """Row counts of every table or view whose name starts with ``prefix``."""
    names = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))
    if not names:
        return spark.createDataFrame([], "table_name string, row_count long")
    return union_all([spark.table(n).groupBy().agg(F.count("*").alias("row_count"))
                   .select(F.lit(n).alias("table_name"), "row_count") for n in names]).orderBy("table_name")


def reconcile_row_counts(t: Tables, expected: dict[str, int] | None = None) -> DataFrame:
    """Actual vs expected rows per table (expected defaults to the full public dataset)."""
    expected = expected or L.EXPECTED_ROWS
    order = ["customers", "orders", "products", "sellers", "category_translation", "order_items",
             "order_payments", "order_reviews", "geolocation"]
    return union_all([t[n].groupBy().agg(F.count("*").alias("actual_rows")).select(
        F.lit(L.TABLE_LABELS[n]).alias("table_name"), "actual_rows",
        F.lit(expected[n]).cast("int").alias("expected_rows")) for n in order])


def duplicate_keys(t: Tables) -> DataFrame:
    """Single-column keys used more than once."""
    checks = [("customers", "customer_id"), ("orders", "order_id"), ("products", "product_id"),
              ("sellers", "seller_id")]
    return union_all([t[tb].groupBy(F.col(k).alias("key_value")).agg(F.count("*").alias("duplicate_count"))
                   .where(F.col("duplicate_count") > 1)
                   .select(F.lit(L.TABLE_LABELS[tb]).alias("table_name"), "key_value", "duplicate_count")
                   for tb, k in checks])


def repeated_review_ids(t: Tables) -> DataFrame:
    """Review ids attached to more than one row."""
    return (t.order_reviews.groupBy("review_id").agg(F.count("*").alias("rows_with_same_review_id"))
            .where(F.col("rows_with_same_review_id") > 1)
            .orderBy(F.col("rows_with_same_review_id").desc(), "review_id"))


def _orphans(child: DataFrame, col: str, parent: DataFrame, pcol: str, skip_null: bool) -> DataFrame:
    c = child.select(F.col(col).alias("__k"))
    if skip_null:
        c = c.where(F.col("__k").isNotNull())
    p = parent.select(F.col(pcol).alias("__k"))
    return c.join(p, "__k", "left_anti")


def orphan_counts(t: Tables) -> DataFrame:
    """Seven referential checks as (check_name, orphan_count)."""
    specs = [
        (t.orders, "customer_id", t.customers, "customer_id", False),
        (t.order_items, "order_id", t.orders, "order_id", False),
        (t.order_items, "product_id", t.products, "product_id", True),
        (t.order_items, "seller_id", t.sellers, "seller_id", True),
        (t.order_payments, "order_id", t.orders, "order_id", False),
        (t.order_reviews, "order_id", t.orders, "order_id", False),
        (t.products, "product_category_name", t.category_translation, "product_category_name", True),
    ]
    return union_all([_orphans(*s).groupBy().agg(F.count("*").alias("orphan_count"))
                   .select(F.lit(name).alias("check_name"), "orphan_count")
                   for name, s in zip(L.ORPHAN_CHECKS, specs)])


def primary_key_contract(t: Tables) -> DataFrame:
    """Per declared key, rows with a NULL key part and key values used twice or more.

    One aggregation per table: key groups are counted once and the NULL-key
    rows are summed from the same grouped rows.
    """
    frames = []
    for table, keys in schemas.PRIMARY_KEYS.items():
        not_null = [n for n, _, nn in schemas.SILVER_COLUMNS[table] if nn]
        null_any = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in set(keys) | set(not_null)])
        g = t[table].groupBy(*keys).agg(F.count("*").alias("__n"), _count_if(null_any).alias("__nulls"))
        frames.append(g.groupBy().agg(
            F.coalesce(F.sum("__nulls"), F.lit(0)).cast("long").alias("null_key_rows"),
            _count_if(F.col("__n") > 1).alias("duplicate_key_groups"))
            .select(F.lit(L.TABLE_LABELS[table]).alias("table_name"), F.lit(", ".join(keys)).alias("key_columns"),
                    F.coalesce("null_key_rows", F.lit(0)).cast("long").alias("null_key_rows"),
                    F.coalesce("duplicate_key_groups", F.lit(0)).cast("long").alias("duplicate_key_groups")))
    return union_all(frames)


def foreign_key_contract(t: Tables) -> DataFrame:
    """Declared foreign keys; a NULL reference is allowed, a dangling one is a violation."""
    return union_all([_orphans(t[c], cc, t[p], pc, True).groupBy().agg(F.count("*").alias("violation_count"))
                   .select(F.lit(L.TABLE_LABELS[c]).alias("child_table"), F.lit(cc).alias("child_column"),
                           F.lit(L.TABLE_LABELS[p]).alias("parent_table"), "violation_count")
                   for c, cc, p, pc in schemas.FOREIGN_KEYS])


def data_quality_counts(t: Tables) -> list:
    """The 14 issue counts as one row with columns c0..c13 (report order)."""
    o, i, p, r, g = t.orders, t.order_items, t.order_payments, t.order_reviews, t.geolocation
    delivered = F.col("order_status") == "delivered"
    pt, ap, dl = F.col("order_purchase_timestamp"), F.col("order_approved_at"), F.col("order_delivered_customer_date")
    oc = o.groupBy().agg(
        _count_if(delivered & dl.isNull()).alias("c0"),
        _count_if(delivered & F.col("order_delivered_carrier_date").isNull()).alias("c1"),
        _count_if(pt.isNotNull() & ap.isNotNull() & (ap < pt)).alias("c12"),
        _count_if(pt.isNotNull() & dl.isNotNull() & (dl < pt)).alias("c13"))
    no_pay = o.select("order_id").join(p.select("order_id"), "order_id", "left_anti").groupBy().agg(F.count("*").alias("c2"))
    no_item = o.select("order_id").join(i.select("order_id"), "order_id", "left_anti").groupBy().agg(F.count("*").alias("c3"))
    s = F.col("review_score")
    rc = r.groupBy().agg(_count_if(s.isNotNull() & ((s < 1) | (s > 5))).alias("c4"))
    ic = i.groupBy().agg(_count_if(F.col("price").isNull()).alias("c5"), _count_if(F.col("price") < 0).alias("c6"),
                         _count_if(F.col("freight_value") < 0).alias("c7"))
    pc = p.groupBy().agg(_count_if(F.col("payment_value") < 0).alias("c8"),
                         _count_if(F.col("payment_value").isNull()).alias("c9"))
    lat, lng = F.col("geolocation_lat"), F.col("geolocation_lng")
    gc = g.groupBy().agg(_count_if(lat.isNotNull() & ((lat < -90) | (lat > 90))).alias("c10"),
                         _count_if(lng.isNotNull() & ((lng < -180) | (lng > 180))).alias("c11"))
    # One wide row: the orders counts plus the other tables' counts as scalar
    # subqueries (each packed in a struct, so each table is still scanned once).
    out = oc
    for extra in (no_pay, no_item, rc, ic, pc, gc):
        names = extra.columns
        packed = extra.select(F.struct(*names).alias("s")).scalar()
        out = out.withColumn("__s", packed).select(*out.columns, *[F.col("__s")[n].alias(n) for n in names])
    return out


def data_quality_report(t: Tables) -> DataFrame:
    """14 checks -> (check_name, severity, issue_count, explanation).

    Five table scans plus two anti-joins produce one wide row of counts,
    which ``stack`` turns into the 14 report rows.
    """
    wide = data_quality_counts(t)
    parts = []
    for k, (name, sev, expl) in enumerate(L.DQ_CHECKS):
        parts += [F.lit(name), F.lit(sev), F.coalesce(F.col(f"c{k}"), F.lit(0)).cast("long"), F.lit(expl)]
    stacked = wide.select(F.inline(F.array(*[F.struct(
        parts[4 * k].alias("check_name"), parts[4 * k + 1].alias("severity"),
        parts[4 * k + 2].alias("issue_count"), parts[4 * k + 3].alias("explanation"))
        for k in range(len(L.DQ_CHECKS))])))
    sev_rank = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return stacked.orderBy(sev_rank, F.col("issue_count").desc(), "check_name")


def dq_delivered_without_date(t: Tables, n: int = 50) -> DataFrame:
    """C02."""
    return (t.orders.where((F.col("order_status") == "delivered") & F.col("order_delivered_customer_date").isNull())
            .select("order_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date",
                    "order_estimated_delivery_date")
            .orderBy("order_purchase_timestamp", "order_id").limit(n))


def dq_orders_without_payment(t: Tables, n: int = 50) -> DataFrame:
    """C03."""
    return (t.orders.join(t.order_payments.select("order_id"), "order_id", "left_anti")
            .select("order_id", "order_status", "order_purchase_timestamp")
            .orderBy("order_purchase_timestamp", "order_id").limit(n))


def dq_bad_item_amounts(t: Tables, n: int = 50) -> DataFrame:
    """C04."""
    return (t.order_items.where(F.col("price").isNull() | (F.col("price") < 0) | (F.col("freight_value") < 0))
            .select("order_id", "order_item_id", "product_id", "price", "freight_value")
            .orderBy("order_id", "order_item_id").limit(n))


def constraint_rules(t: Tables) -> list[tuple[str, str, DataFrame, "F.Column"]]:
    """Rule registry: (table, constraint name, table frame, violation predicate)."""
    i, p, r, g, o = t.order_items, t.order_payments, t.order_reviews, t.geolocation, t.orders
    c = F.col
    preds = [
        ("order_items", i, c("order_item_id") <= 0),
        ("order_items", i, (c("price") < 0) | (c("price") > 100000)),
        ("order_items", i, (c("freight_value") < 0) | (c("freight_value") > 100000)),
        ("order_payments", p, (c("payment_value") < 0) | (c("payment_value") > 100000)),
        ("order_payments", p, (c("payment_installments") < 0) | (c("payment_installments") > 100)),
        ("order_reviews", r, (c("review_score") < 1) | (c("review_score") > 5)),
        ("geolocation", g, (c("geolocation_lat") < -90) | (c("geolocation_lat") > 90)),
        ("geolocation", g, (c("geolocation_lng") < -180) | (c("geolocation_lng") > 180)),
        ("orders", o, c("order_purchase_timestamp").isNotNull() & c("order_delivered_customer_date").isNotNull()
         & (c("order_delivered_customer_date") < c("order_purchase_timestamp"))),
    ]
    return [(tb, name, df, pred) for (tb, df, pred), name in zip(preds, L.CONSTRAINT_NAMES)]


def constraint_status(t: Tables) -> DataFrame:
    """Violations per check rule; a rule is enforceable only with 0 violations.

    Rules on the same table are counted in one scan of it: one wide row per table, which
    ``inline`` turns into a row per rule.
    """
    rules = constraint_rules(t)
    frames = []
    by_table: dict[str, list] = {}
    for k, (tb, name, df, pred) in enumerate(rules):
        by_table.setdefault(tb, []).append((k, name, df, pred))
    for tb, items in by_table.items():
        df = items[0][2]
        wide = df.groupBy().agg(*[_count_if(F.coalesce(pred, F.lit(False))).alias(f"v{k}") for k, _, _, pred in items])
        count = lambda k: F.coalesce(F.col(f"v{k}"), F.lit(0)).cast("long")
        frames.append(wide.select(F.inline(F.array(*[F.struct(
            F.lit(L.TABLE_LABELS[tb]).alias("table_name"), F.lit(name).alias("constraint_name"), count(k).alias("violation_count"),
            F.when(count(k) == 0, 1).otherwise(0).alias("enforceable")) for k, name, _, _ in items]))))
    return union_all(frames).orderBy("table_name", "constraint_name")


def constraint_guards(t: Tables) -> DataFrame:
    """Whether any row breaks each check rule: (table_name, constraint_name, violated).

    Every guard is an ``EXISTS`` of its own.  Spark runs it as a limit of one row, which
    reads a partition, then four times as many and so on, and ends at the first violating row.
    """
    rules = constraint_rules(t)
    found = t.spark.range(1).select(*[df.where(pred).exists().cast("int").alias(f"v{k}") for k, (_, _, df, pred) in enumerate(rules)])
    return found.select(F.inline(F.array(*[F.struct(F.lit(L.TABLE_LABELS[tb]).alias("table_name"), F.lit(name).alias("constraint_name"),
                                                    F.col(f"v{k}").alias("violated")) for k, (tb, name, _, _) in enumerate(rules)])))


def ensure(t: Tables, constraint: str) -> None:
    """Raise if a row breaks the check rule of this name, at the first one that is found."""
    for tb, name, df, pred in constraint_rules(t):
        if name == constraint:
            if (row := df.where(pred).first()) is not None:
                raise ValueError(f"{L.TABLE_LABELS[tb]} breaks {name}: {row.asDict()}")
            return
    raise KeyError(constraint)


def verdicts(t: Tables, table: str) -> DataFrame:
    """The table's rows with ``broken_rules``, the sorted names of the check rules that each breaks."""
    named = [F.when(F.coalesce(pred, F.lit(False)), F.lit(name)) for tb, name, _, pred in constraint_rules(t) if tb == table]
    broken = F.array_sort(F.array_compact(F.array(*named))) if named else F.array().cast("array<string>")
    return t[table].withColumn("broken_rules", broken)


def quarantine(t: Tables, table: str) -> tuple[DataFrame, DataFrame]:
    """Split a table into (rows passing every rule, rows violating any rule)."""
    rows, bad = verdicts(t, table), F.size("broken_rules") > 0
    return rows.where(~bad).drop("broken_rules"), rows.where(bad).drop("broken_rules")


def write_quarantine(t: Tables, table: str, path: str) -> dict[str, int]:
    """Write a table in one pass, accepted and rejected rows in folders of their own.

    Returns the numbers of rows read, accepted and rejected, which Spark observes while it
    writes; rejected rows carry ``broken_rules``.
    """
    bad = F.size("broken_rules") > 0
    seen = Observation(f"quarantine {table}")
    rows = verdicts(t, table).withColumn("verdict", F.when(bad, "rejected").otherwise("accepted"))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"))
    rows.write.mode("overwrite").partitionBy("verdict").parquet(path)
    return dict(seen.get)


def assert_contracts(t: Tables) -> None:
    """Fail fast when a declared key or reference does not hold (the gate
    before building views on the silver tables)."""
    bad = [f"{r.table_name}({r.key_columns}): {r.null_key_rows} NULL key rows, "
           f"{r.duplicate_key_groups} duplicated keys"
           for r in primary_key_contract(t).collect() if r.null_key_rows or r.duplicate_key_groups]
    bad += [f"{r.child_table}.{r.child_column} -> {r.parent_table}: {r.violation_count} dangling"
            for r in foreign_key_contract(t).collect() if r.violation_count]
    if bad:
        raise ValueError("contract violations: " + "; ".join(bad))
