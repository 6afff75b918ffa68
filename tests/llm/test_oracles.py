"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import turnlens.llm.queries  # noqa: F401 - fills the registry
from turnlens.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "embeddings", "labels"):
        if os.path.exists(f"{SF}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_as_sql(spark, db, key):
    got = QUERIES[key](spark, SF)
    want = db.execute(ORACLES[key])
    names = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == names
    at = [[c[0] for c in want.description].index(n) for n in names]
    rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == rows
