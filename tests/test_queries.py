"""Every query with SQL is held against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from hearthledger.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rel = duck.sql(catalogue.ORACLE[name])
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    columns = sorted(df.columns)
    at = [rel.columns.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([[r[i] for i in at] for r in rel.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
