"""Plan assertions: pushdown, pruning and no single-partition windows over facts."""

import tempfile

from marketlens.operators import analysis, explore, insight
from marketlens.sources import catalog


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_projection_reach_the_silver_scan(spark, tables):
    out = tempfile.mkdtemp(prefix="marketlens-silver-")
    catalog.write_silver(tables, out)
    silver = catalog.from_parquet(spark, out)
    df = explore.order_payments_in_window(silver, "1997-01-01 00:00:00", "1998-02-02 00:00:00")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(order_purchase_timestamp), GreaterThanOrEqual(order_purchase_timestamp" in plan
    # the delivered-order view reads only the order columns it needs
    v04 = analysis.delivered_order_preview(silver)
    assert "ReadSchema: struct<order_id:string,customer_id:string,order_status:string" in _plan(v04)


def test_ranked_views_have_no_single_partition_exchange(tables, monkeypatch):
    from marketlens.functions import ranking
    monkeypatch.setattr(ranking, "ROWS_PER_RANGE", 3)  # force several ranges on the small fixture
    for df in (insight.customer_value_tiers(tables), analysis.seller_rank(tables)):
        for above in _plan(df).split("Exchange SinglePartition")[1:]:
            assert "HashAggregate(keys=[__range" in above.split("\n")[1]  # one row per range


def _silver(spark, tables):
    out = tempfile.mkdtemp(prefix="marketlens-silver-")
    catalog.write_silver(tables, out)
    return catalog.from_parquet(spark, out)


def test_order_files_hold_separate_time_ranges(spark, tables):
    import glob

    import pyarrow.parquet as pq
    out = tempfile.mkdtemp(prefix="marketlens-silver-")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else this little is one file
    try:
        catalog.write_silver(tables, out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spans = []
    for f in glob.glob(f"{out}/orders/*.parquet"):
        times = [t for t in pq.read_table(f, columns=["order_purchase_timestamp"]).column(0).to_pylist() if t is not None]
        spans += [(min(times), max(times))] if times else []
    spans.sort()
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_files_per_bucket_do_not_change_the_rows(spark, tables):
    out = tempfile.mkdtemp(prefix="marketlens-bucketed-")
    bt = catalog.write_silver_bucketed(tables, out, "marketlens_test_files", 3, files_per_bucket=2)
    for t in catalog.ORDER_KEYED:
        assert bt[t].count() == tables[t].count() and bt[t].exceptAll(tables[t]).count() == 0
    assert catalog.bucket_count(tables) >= 1


def test_constraint_status_scans_each_table_once(spark, tables):
    from marketlens.operators import integrity
    silver = _silver(spark, tables)
    scans = [x for x in _plan(integrity.constraint_status(silver)).split("\n") if "FileScan" in x]
    assert len(scans) == 5  # items, payments, reviews, geolocation, orders


def test_nested_distinct_counts_need_no_expand(spark, tables):
    assert "Expand" not in _plan(insight.category_seller_region_gmv(_silver(spark, tables)))


def test_seller_retention_joins_finished_sellers(spark, tables):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(insight.seller_retention(_silver(spark, tables)))
        top = next(x for x in plan.split("\n") if "Join" in x)
        assert "LeftOuter" in top  # above it nothing is grouped by seller any more
        assert "HashAggregate" not in plan[:plan.index(top)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_bucketed_silver_removes_order_grain_shuffles(spark, tables):
    from marketlens.operators import base
    out = tempfile.mkdtemp(prefix="marketlens-bucketed-")
    bt = catalog.write_silver_bucketed(tables, out, "marketlens_test_bucketed", 4)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = base.order_payment(bt)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan          # group by order_id on tables bucketed by order_id
        v04 = base.delivered_order_base(bt)._jdf.queryExecution().toString()
        # only the customer join (both sides) shuffles; item and payment aggregates stay in their buckets
        assert v04.count("Exchange hashpartitioning") <= 2
        assert "Exchange" not in base.order_item_summary(bt)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_tasks_of_fine_groups_follow_the_rows(spark, tables, monkeypatch):
    """More rows make more partitions, with the same rows, not more groups in each of the usual number."""
    from marketlens.functions import parts
    silver = _silver(spark, tables)
    views = (insight.category_seller_region_gmv, insight.cross_sell_category_pairs, lambda t: explore.state_flow_freight(t, 10_000))
    whole = [sorted(map(str, view(silver).collect())) for view in views]
    monkeypatch.setattr(parts, "ROWS_PER_TASK", 100)
    needed = -(-silver.order_items.count() // 100)
    for view, rows in zip(views, whole):
        df = view(silver)
        assert f", {needed}), REPARTITION_BY_NUM" in _plan(df)
        assert sorted(map(str, df.collect())) == rows
