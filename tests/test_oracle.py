"""Every query against its SQL counterpart, row by row."""

import duckdb
import pytest

import __spark_entry__
from sitestance.plans import catalog, oracle

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
QUERIES = catalog.CATALOG
SQL = oracle.queries()


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def test_entry_has_all_queries():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, db, name):
    found = QUERIES[name](spark, sf_dir)
    expected = db.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[t] for c, t in found.dtypes} == types
    order = [expected.columns.index(c) for c in columns]
    ours = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    theirs = sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=repr)
    assert ours == theirs
