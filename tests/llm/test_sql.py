"""The operators that SQL can state, against DuckDB over the same tables."""

import duckdb
import pytest

from compare import compare
from resgov.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    found = compare(spark, SF, name, queries()[name], oracle_sql()[name], con)
    assert found["ok"] and found["spark_rows"] > 0, found
