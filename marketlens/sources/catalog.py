"""The table catalog: a named bundle of the nine silver DataFrames.

Operators take a ``Tables`` and return DataFrames; they never read paths
themselves, so the same operator runs on the stand-in test tables, on
cleaned raw text, or on persisted silver parquet.
"""

from __future__ import annotations

import hashlib
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from marketlens.sources import schemas, testdata


class Tables:
    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], gold_dir: str | None = None):
        self.spark = spark
        self._frames = dict(frames)
        self.gold_dir = gold_dir
        self._gold: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name in frames:
            return frames[name]
        raise AttributeError(name)

    def __getitem__(self, name: str) -> DataFrame:
        return self._frames[name]

    def names(self) -> list[str]:
        return list(self._frames)

    def with_frames(self, **frames: DataFrame) -> "Tables":
        """A copy with some tables replaced; shared views are not reused."""
        merged = dict(self._frames)
        merged.update(frames)
        return Tables(self.spark, merged)

    def view(self, name: str, build) -> DataFrame:
        """A shared view: built lazily, or persisted once as a gold parquet
        table (under the shared checkpoint folder) when ``gold_dir`` is set."""
        if self.gold_dir is None:
            return build()
        if name not in self._gold:
            path = f"{self.gold_dir}/{name}"
            build().write.mode("overwrite").parquet(path)
            self._gold[name] = read_fresh(self.spark, path)
        return self._gold[name]


def from_testdata(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy silver tables derived from the driver's parquet tables."""
    return Tables(spark, {name: build(spark, sf_dir) for name, build in testdata.BUILDERS.items()})


def read_fresh(spark: SparkSession, path: str) -> DataFrame:
    """Read a parquet folder that may have been overwritten in this session.

    The session caches directory listings; refreshing the path first avoids
    reading files an overwrite has already removed.
    """
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def from_parquet(spark: SparkSession, silver_dir: str) -> Tables:
    return Tables(spark, {t: read_fresh(spark, f"{silver_dir.rstrip('/')}/{t}") for t in schemas.TABLES})


def footer_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table_name, row_count) of parquet folders, from the files' footers.

    The scans ask for no column, so Spark's reader takes the numbers of rows of the row
    groups, which the footers hold, and reads no data page.
    """
    counts = [spark.read.parquet(path).groupBy().agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, path in paths.items()]
    return reduce(DataFrame.unionAll, counts)


ORDER_KEYED = ("orders", "order_items", "order_payments", "order_reviews")


def write_silver(tables: Tables, out_dir: str, mode: str = "overwrite") -> None:
    """Persist silver tables (the reference's typed base tables) as parquet.

    Orders are dealt to files by purchase time, so a time window reads few files.
    The other fact tables keyed by ``order_id`` are sorted by that key within
    partitions, so parquet row-group statistics prune point lookups.
    """
    for t in schemas.TABLES:
        df = tables[t]
        if t == "orders":
            # the ranges come from a sample, so orders are read twice; they are parsed once
            parsed = df.persist(StorageLevel.DISK_ONLY)
            df = df.repartitionByRange("order_purchase_timestamp", "order_id").sortWithinPartitions("order_purchase_timestamp", "order_id")
        elif t in ORDER_KEYED:
            df = df.sortWithinPartitions("order_id")
        try:
            df.write.mode(mode).parquet(f"{out_dir.rstrip('/')}/{t}")
        finally:
            if t == "orders":
                parsed.unpersist()


#: Items in a bucket of bucketed silver.
ROWS_PER_BUCKET = 5_000_000


def bucket_count(tables: Tables) -> int:
    """Buckets for the size of the largest order-keyed table, at least as many as shuffle partitions."""
    least = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-tables["order_items"].count() // ROWS_PER_BUCKET))


def write_silver_bucketed(tables: Tables, out_dir: str, database: str, buckets: int | None = None,
                          files_per_bucket: int = 1) -> Tables:
    """Persist silver as catalog tables; order-keyed facts bucketed by order_id.

    Orders, items, payments and reviews share the bucket count, so the
    order-grain aggregations (V01-V03) and their joins to orders (V04) run
    without any shuffle: every bucket holds the same order ids in all four
    tables.  A bucket is written by ``files_per_bucket`` tasks, a file each: as the
    number of tasks is a multiple of the buckets, a task has rows of one bucket only.
    """
    spark = tables.spark
    buckets = buckets or bucket_count(tables)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    frames = {}
    for t in schemas.TABLES:
        name = f"{database}.{t}"
        w = tables[t]
        if t in ORDER_KEYED:
            (w.repartition(buckets * files_per_bucket, "order_id").write.mode("overwrite")
             .bucketBy(buckets, "order_id").sortBy("order_id")
             .option("path", f"{out_dir.rstrip('/')}/{t}").saveAsTable(name))
        else:
            w.write.mode("overwrite").option("path", f"{out_dir.rstrip('/')}/{t}").saveAsTable(name)
        frames[t] = spark.table(name)
    return Tables(spark, frames)


_CACHE: dict[tuple[int, str], Tables] = {}


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """Silver tables for a test-data folder.

    With ``MARKETLENS_SILVER=materialize`` (used by bench) the silver layer is
    built once per session into the shared checkpoint folder and read back,
    which cuts the adapter's lineage exactly like the reference's persisted
    base tables.  Otherwise the lazy adapter plan is returned.
    """
    mode = os.environ.get("MARKETLENS_SILVER", "lazy")
    if mode not in ("materialize", "bucketed"):
        return from_testdata(spark, sf_dir)
    key = (id(spark), os.path.abspath(sf_dir))
    if key not in _CACHE:
        from marketlens.session import ensure_checkpoint_dir
        root = ensure_checkpoint_dir(spark).rstrip("/")
        tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
        out = f"{root}/silver-{tag}"
        if mode == "bucketed":
            buckets = int(os.environ.get("MARKETLENS_BUCKETS", "0")) or None
            tables = write_silver_bucketed(from_testdata(spark, sf_dir), out, f"marketlens_{tag}", buckets)
        else:
            write_silver(from_testdata(spark, sf_dir), out)
            tables = from_parquet(spark, out)
        tables.gold_dir = f"{root}/gold-{tag}"
        _CACHE[key] = tables
    return _CACHE[key]
