"""Queries with a SQL form against it, on the small tables."""

import duckdb
import pytest

from ndspark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_those_of_the_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    rows = sorted(map(str, (tuple(r) for r in want.fetchall())))
    found = queries.QUERIES[name](spark, FOLDER).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in found) == rows and rows
