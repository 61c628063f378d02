"""Every registered query of the engine against its SQL, at the smallest scale."""

import decimal
import os

import duckdb
import pytest

from weftline.catalog import ORACLE_SQL, QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return con


def shown(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(float(value) + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    kinds = dict(df.dtypes)
    sql_kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[kinds[c]] for c in columns} == {c: sql_kinds[c] for c in columns}
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in rows) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
