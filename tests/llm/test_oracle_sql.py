"""The training-data queries that have SQL, against DuckDB."""

import duckdb
import pytest

from kestrelbase.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF).toArrow().to_pylist()
    want = db.execute(queries.ORACLE_SQL[name]).to_arrow_table().to_pylist()
    assert sorted(str(sorted(r.items())) for r in got) == sorted(str(sorted(r.items())) for r in want)
