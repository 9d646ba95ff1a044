"""Every registered query equals its DuckDB SQL twin on the sf0.001 tables."""

import pytest

import __spark_entry__ as entry
from marketlens.plans import registry
from tests.compare import canon, duck_rows, spark_rows

registry.load_all()
QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
SMALL = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def _type(dt) -> str:
    n = dt.typeName()
    if n == "decimal":
        return f"DECIMAL({dt.precision},{dt.scale})"
    return {"long": "BIGINT", "integer": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
            "date": "DATE", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(n, n)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SMALL)
    cols, rows = spark_rows(df)
    dcols, drows = duck_rows(duck, ORACLE[key])
    assert sorted(cols) == sorted(dcols)
    assert canon(cols, rows) == canon(dcols, drows)
    dtypes = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {ORACLE[key]}").fetchall()}
    assert {f.name: _type(f.dataType) for f in df.schema.fields} == dtypes


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "delivered_order_count" in df.columns
