"""Every named query against its DuckDB SQL on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from kestrelbase.plans import named

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def rows(t):
    return sorted(str(sorted((k, plain(v)) for k, v in r.items())) for r in t.to_pylist())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(named.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    want = rows(db.execute(entry.oracle_sql()[name]).to_arrow_table())
    assert want, "two empty results show nothing"
    assert rows(entry.queries()[name](spark, SF).toArrow()) == want


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", sorted(set(named.QUERIES) - set(named.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
