"""Every registered query against DuckDB over the whole tables."""

from __future__ import annotations

import os

import pytest
from conftest import DATA
from oracle import duck_rows, spark_rows

from __spark_entry__ import entry, oracle_sql, queries
from millrace.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    sf_dir = DATA / f"sf{os.environ.get('TEST_SF', '0.01')}"
    expected_columns, expected = duck_rows(sf_dir, ORACLES[name])
    columns, rows = spark_rows(QUERIES[name](spark, str(sf_dir)))
    assert columns == expected_columns
    assert sum(rows.values()) == sum(expected.values()) > 0
    assert rows == expected


def test_entry(spark):
    df = entry(spark)
    assert len(df.columns) == 11 and "valor" in df.columns
    assert df.count() > 0


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= queries().keys() and ORACLES.keys() <= oracle_sql().keys()
