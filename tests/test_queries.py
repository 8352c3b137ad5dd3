"""Every named query against its oracle SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from signaldeck.plans import catalog

FOLDER = "/root/testdata/sf0.001"
ORACLES = catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) - set(ORACLES) == set()


def test_entry(spark):
    assert entry.entry(spark).columns == ["group_0", "bucket_ms", "value"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert compare(got, duck.execute(ORACLES[name]).df()) == "ok"
