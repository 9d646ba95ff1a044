"""Registered cleaning queries (D01-D10) and their SQL twins.

The bronze input is the silver stand-in rendered back to raw text (padding
blanks, '' for NULL, zip codes without leading zeros, date-only midnights);
cleaning it must give the silver rows back.  The oracle renders and cleans
in SQL on its own.
"""

from __future__ import annotations

from marketlens.operators import cleaning
from marketlens.operators.integrity import staging_row_counts
from marketlens.plans.oracle_base import LIB
from marketlens.plans.registry import QUERIES, ORACLE
from marketlens.sources import bronze, catalog, schemas
from marketlens.sources.bronze import ZIP_COLUMNS


def _dirty_sql(table: str) -> str:
    cols = []
    for name, dtype, _ in schemas.SILVER_COLUMNS[table]:
        kind = dtype.typeName()
        if name in ZIP_COLUMNS:
            text = f"CAST(CAST({name} AS INTEGER) AS VARCHAR)"
        elif kind in ("timestamp_ntz", "timestamp"):
            text = (f"CASE WHEN hour({name}) = 0 AND minute({name}) = 0 AND second({name}) = 0 "
                    f"THEN strftime({name}, '%Y-%m-%d') ELSE strftime({name}, '%Y-%m-%d %H:%M:%S') END")
        else:
            text = f"CAST({name} AS VARCHAR)"
        cols.append(f"CASE WHEN {name} IS NULL THEN '' ELSE ' ' || {text} || ' ' END AS {name}")
    return f"SELECT {', '.join(cols)} FROM sv_{table}"


def _clean_sql(table: str) -> str:
    cols = []
    for name, dtype, _ in schemas.SILVER_COLUMNS[table]:
        kind = dtype.typeName()
        s = f"NULLIF(trim({name}), '')"
        if name in ZIP_COLUMNS:
            e = f"CASE WHEN {s} IS NULL THEN NULL ELSE right('00000' || trim({name}), 5) END"
        elif (table, name) in cleaning.TRUNCATE:
            e = f"left({s}, {cleaning.TRUNCATE[(table, name)]})"
        elif kind == "integer":
            e = f"TRY_CAST({s} AS INTEGER)"
        elif kind == "decimal":
            e = f"TRY_CAST({s} AS DECIMAL({dtype.precision},{dtype.scale}))"
        elif kind in ("timestamp_ntz", "timestamp"):
            e = f"COALESCE(TRY_STRPTIME({s}, '%Y-%m-%d %H:%M:%S'), TRY_STRPTIME({s}, '%Y-%m-%d'))"
        else:
            e = s
        cols.append(f"{e} AS {name}")
    where = " AND ".join(f"{n} IS NOT NULL" for n in cleaning.REQUIRED[table]) or "TRUE"
    return f"SELECT * FROM (SELECT {', '.join(cols)} FROM stg_{table}) c WHERE {where}"


for _t in schemas.TABLES:
    LIB.add(f"stg_{_t}", _dirty_sql(_t))


def _make(table: str):
    def run(spark, sf_dir):
        dirty = bronze.render_dirty(catalog.load(spark, sf_dir))
        return cleaning.clean_table(table, dirty[table])
    run.__doc__ = f"D: clean the raw text rows of {table}."
    return run


for _t in schemas.TABLES:
    QUERIES[f"clean_{_t}"] = _make(_t)
    ORACLE[f"clean_{_t}"] = LIB.build(_clean_sql(_t))


def _staging(spark, sf_dir):
    bronze.register_staging(spark, bronze.render_dirty(catalog.load(spark, sf_dir)))
    return staging_row_counts(spark, "stg_")


QUERIES["staging_row_counts"] = _staging
ORACLE["staging_row_counts"] = LIB.build(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{schemas.BRONZE_NAMES[t]}' AS table_name, COUNT(*) AS row_count FROM stg_{t}"
        for t in schemas.TABLES) + ") ORDER BY table_name")
