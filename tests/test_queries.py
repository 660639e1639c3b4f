"""Every named query against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from histlab.plans.oracle import oracle_sql
from histlab.plans.queries import queries

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in oracle_sql():
        assert got
        return
    result = duck.sql(oracle_sql()[name])
    at = [result.columns.index(c) for c in columns]
    assert got == sorted([plain(r[i]) for i in at] for r in result.fetchall())
