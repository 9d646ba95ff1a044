"""Batch rebuild: raw text -> silver -> every published view, in versions.

This is the original's top-to-bottom rebuild: staging profile, cleaning, the key and
reference gate, persisted typed tables, then the views.  A rebuild writes to a folder of
its own and touches nothing that readers use.  When all is written, one small file,
``CURRENT``, is exchanged in a single step; it names the version that readers see.  A
rebuild that fails, at the gate or anywhere else, leaves the version before as it was.
Versions beyond the last few are removed after the exchange.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from marketlens.operators import cleaning, integrity
from marketlens.plans import views
from marketlens.sources import bronze, catalog, files
from marketlens.sources.catalog import Tables

POINTER = "CURRENT"
#: Versions that stay after a rebuild, the new one included.
KEEP = 2


class Published(NamedTuple):
    """What readers see: the version, its typed tables and its views."""

    version: str
    tables: Tables
    views: dict[str, DataFrame]


def rebuild(spark: SparkSession, raw: dict[str, DataFrame], out_dir: str, gate: bool = True,
            names: list[str] | None = None, build: dict[str, Callable] | None = None, keep: int = KEEP) -> dict[str, str]:
    """Clean ``raw`` bronze frames, persist silver and the views in a new version under ``out_dir``, and publish it.

    Returns {name: path}.  With ``gate`` the key/reference contracts must hold
    before any view is built (the original declares its keys at this point).
    """
    out_dir = out_dir.rstrip("/")
    version = f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:12]}"
    folder = f"{out_dir}/versions/{version}"
    bronze.register_staging(spark, raw)
    catalog.write_silver(Tables(spark, cleaning.clean_all(raw)), f"{folder}/silver", mode="errorifexists")
    silver = catalog.from_parquet(spark, f"{folder}/silver")
    if gate:
        integrity.assert_contracts(silver)
    written = {t: f"{folder}/silver/{t}" for t in silver.names()}
    for name, fn in (build or views.VIEWS).items():
        if names is None or name in names:
            fn(silver).write.parquet(f"{folder}/gold/{name}")
            written[name] = f"{folder}/gold/{name}"
    views_written = sorted(set(written) - set(silver.names()))
    before = _pointer(spark, out_dir)
    history = ([before["version"], *before["history"]] if before else [])[:max(0, keep - 1)]
    files.write_text(spark, f"{out_dir}/{POINTER}", json.dumps({"version": version, "views": views_written, "history": history}))
    drop_old(spark, out_dir)
    return written


def _pointer(spark: SparkSession, out_dir: str) -> dict | None:
    text = files.read_text(spark, f"{out_dir.rstrip('/')}/{POINTER}")
    return json.loads(text) if text else None


def published(spark: SparkSession, out_dir: str) -> Published:
    """The tables and views of the version that is published under ``out_dir``."""
    now = _pointer(spark, out_dir)
    if now is None:
        raise FileNotFoundError(f"nothing is published in {out_dir}")
    folder = f"{out_dir.rstrip('/')}/versions/{now['version']}"
    return Published(now["version"], catalog.from_parquet(spark, f"{folder}/silver"),
                     {name: catalog.read_fresh(spark, f"{folder}/gold/{name}") for name in now["views"]})


def drop_old(spark: SparkSession, out_dir: str) -> list[str]:
    """Remove versions older than those that ``CURRENT`` names.

    Folders of rebuilds that are newer than the published one are left: they may still run.
    """
    now = _pointer(spark, out_dir)
    stay = {now["version"], *now["history"]}
    old = [v for v in files.names(spark, f"{out_dir.rstrip('/')}/versions") if v not in stay and v < now["version"]]
    for v in old:
        files.remove(spark, f"{out_dir.rstrip('/')}/versions/{v}")
    return old


def publish(spark: SparkSession, out_dir: str) -> list[str]:
    """Register the published version's tables and views under their original names."""
    now = published(spark, out_dir)
    for table, name in views.TABLE_NAMES.items():
        now.tables[table].createOrReplaceTempView(name)
    for name, df in now.views.items():
        df.createOrReplaceTempView(name)
    return list(now.views)
