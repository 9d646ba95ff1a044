import pytest

from marketlens.operators import base, integrity, lookup
from marketlens.plans import rebuild, views
from marketlens.sources import bronze, catalog, files

NAMES = ["v_phase3_monthly_business", "v_phase3_seller_summary"]


def test_a_failed_rebuild_leaves_the_published_version(spark, tables, tmp_path):
    raw, out = bronze.render_dirty(tables), str(tmp_path / "p")
    with pytest.raises(FileNotFoundError):
        rebuild.published(spark, out)
    rebuild.rebuild(spark, raw, out, names=NAMES)
    first = rebuild.published(spark, out)
    want = sorted(map(tuple, first.views[NAMES[0]].collect()))

    def fails(t):
        raise RuntimeError("midway")

    build = {NAMES[0]: lambda t: base.monthly_business(t).limit(1), NAMES[1]: fails}
    with pytest.raises(RuntimeError, match="midway"):
        rebuild.rebuild(spark, raw, out, build=build)
    # one view of the failed version was written already, and a reader does not see it
    assert len(files.names(spark, f"{out}/versions")) == 2
    now = rebuild.published(spark, out)
    assert now.version == first.version and sorted(map(tuple, now.views[NAMES[0]].collect())) == want
    assert sorted(map(tuple, first.views[NAMES[0]].collect())) == want  # and what a reader holds goes on


def test_the_gate_stops_a_rebuild(spark, tables, tmp_path):
    raw, out = bronze.render_dirty(tables), str(tmp_path / "p")
    raw["orders"] = raw["orders"].unionAll(raw["orders"].limit(1))
    with pytest.raises(ValueError, match="duplicated keys"):
        rebuild.rebuild(spark, raw, out, names=NAMES[:1])
    with pytest.raises(FileNotFoundError):
        rebuild.published(spark, out)


def test_old_versions_go(spark, tables, tmp_path):
    raw, out = bronze.render_dirty(tables), str(tmp_path / "p")
    seen = []
    for _ in range(3):
        rebuild.rebuild(spark, raw, out, gate=False, names=NAMES[:1])
        seen.append(rebuild.published(spark, out).version)
    assert set(files.names(spark, f"{out}/versions")) <= set(seen) and seen[-1] in files.names(spark, f"{out}/versions")
    assert seen[0] not in files.names(spark, f"{out}/versions") or seen[0] > seen[-1]
    assert rebuild.publish(spark, out) == NAMES[:1]
    assert spark.table(NAMES[0]).count() == base.monthly_business(tables).count()


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "d/x")
    assert files.read_text(spark, path) is None and files.names(spark, str(tmp_path / "d")) == []
    files.write_text(spark, path, "é1")
    files.write_text(spark, path, "two\n")
    assert files.read_text(spark, path) == "two\n" and files.names(spark, str(tmp_path / "d")) == ["x"]
    files.remove(spark, path)
    assert files.read_text(spark, path) is None


def test_quarantine_is_one_pass_that_loses_no_row(spark, tables, tmp_path):
    path = str(tmp_path / "q")
    seen = integrity.write_quarantine(tables, "order_items", path)
    rows = catalog.read_fresh(spark, path)
    assert seen["rows"] == seen["accepted"] + seen["rejected"] == tables["order_items"].count() == rows.count()
    assert seen["rejected"] == rows.where("verdict = 'rejected'").count() > 0
    assert rows.where("(verdict = 'rejected') <> (size(broken_rules) > 0)").count() == 0


def test_guards_stop_at_the_first_violating_row(spark, tables):
    counts = {r.constraint_name: r.violation_count for r in integrity.constraint_status(tables).collect()}
    guards = {r.constraint_name: r.violated for r in integrity.constraint_guards(tables).collect()}
    assert guards == {k: int(n > 0) for k, n in counts.items()} and set(guards.values()) == {0, 1}
    for name, n in counts.items():
        if n:
            with pytest.raises(ValueError, match=name):
                integrity.ensure(tables, name)
        else:
            integrity.ensure(tables, name)
    with pytest.raises(KeyError):
        integrity.ensure(tables, "no such rule")


def test_a_guard_reads_few_rows(spark):
    """A violating row in the first of many partitions ends the check: later partitions are not computed."""
    from pyspark.sql import functions as F
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 100_000, numPartitions=50).mapInArrow(count, "id long")
    assert spark.range(1).select(df.where(F.col("id") >= 5).exists().alias("x")).first().x
    assert seen.value < 50_000


def test_lookups_as_table_functions(spark, tables):
    views.publish_functions(tables)
    seller = lookup.sample_argument(tables, "seller_id")
    got = spark.sql("SELECT * FROM seller_performance(seller_id => :s)", {"s": seller}).collect()
    assert got == lookup.seller_performance(tables, seller).collect()
    for call in ("customer_order_history(customer_unique_id => ' ')", "customer_order_history(NULL)", "seller_performance(seller_id => '')"):
        with pytest.raises(Exception, match="is required"):
            spark.sql(f"SELECT * FROM {call}").collect()
    assert spark.sql("SELECT * FROM customer_order_history('nobody')").count() == 0


def test_footer_counts_read_no_data(spark):
    d = "/root/testdata/sf0.001"
    df = catalog.footer_counts(spark, {"orders": f"{d}/orders.parquet", "events": f"{d}/events.parquet"})
    plan = df._jdf.queryExecution().toString()
    assert plan.count("ReadSchema: struct<>") >= 2 and plan.count("ReadSchema: struct<") == plan.count("ReadSchema: struct<>")
    assert {r.table_name: r.row_count for r in df.collect()} == {t: spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("orders", "events")}


def test_orders_are_parsed_once_for_their_ranges(spark, tmp_path):
    from pyspark.sql import functions as F
    from marketlens.sources import catalog, schemas

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frames = {t: spark.createDataFrame([], ", ".join(f"{n} {d.simpleString()}" for n, d, _ in schemas.SILVER_COLUMNS[t])) for t in schemas.TABLES}
    made = spark.range(0, 300, 1, 3).select(*[F.expr({"order_id": "concat('o', id)", "order_purchase_timestamp": "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id % 7 as int))"}
                                                     .get(n, "null")).cast(d).alias(n) for n, d, _ in schemas.SILVER_COLUMNS["orders"]])
    frames["orders"] = made.mapInArrow(counted, made.schema)
    catalog.write_silver(catalog.Tables(spark, frames), str(tmp_path / "silver"))
    assert read.value == 300
    assert spark.read.parquet(str(tmp_path / "silver" / "orders")).count() == 300
    assert not spark.sparkContext._jsc.getPersistentRDDs()
