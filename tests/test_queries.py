"""Every query with SQL gives the SQL's rows."""

import decimal
import math

import duckdb
import pytest

from kmerloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, (bytearray, bytes)):
        return bytes(x).decode()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return int(x) if isinstance(x, decimal.Decimal) and x == int(x) else x


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(registry.ORACLE[name])
    assert columns == sorted(want.columns)
    a = sorted([tuple(value(r[c]) for c in columns) for r in got.collect()], key=str)
    at = [want.columns.index(c) for c in columns]
    b = sorted([tuple(value(r[i]) for i in at) for r in want.fetchall()], key=str)
    assert len(a) == len(b) and a == b
    assert a
