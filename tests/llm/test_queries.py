"""Registered queries of the subpackage against their SQL on the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from snapdelta.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    expected = connection.execute(queries.ORACLES[name])
    names = sorted(c[0] for c in expected.description)
    rows = expected.fetchdf()[names].astype(object).values.tolist()
    found = queries.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == names
    assert sorted(map(str, rows)) == sorted(str([r[n] for n in names]) for r in found.collect())


def test_all_are_registered():
    names = set(contract.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
