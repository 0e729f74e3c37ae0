"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from snapdelta.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables not present")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def table(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(normal(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, database, name):
    result = contract.queries()[name](spark, SF_DIR)
    expected = database.execute(contract.oracle_sql()[name])
    assert table(result.columns, result.collect()) == table([c[0] for c in expected.description], expected.fetchall())


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["doc_id", "current_hash"] and result.count() > 0
