"""The queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from foldspark.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = queries()[name](spark, DATA)
    columns = found.columns
    wanted = db.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in found.collect()) == order(wanted)
