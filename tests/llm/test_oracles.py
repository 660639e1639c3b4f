import duckdb
import pytest

from histlab.llm.oracle import oracle_sql
from histlab.llm.queries import queries

from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = duck.sql(oracle_sql()[name])
    got = queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
