"""Every query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from folioforge.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql():
    made = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        made.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return made


def rows(found):
    return sorted(tuple("null" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    df, want = QUERIES[name](spark, SF), sql.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == kinds
    assert rows(df.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
