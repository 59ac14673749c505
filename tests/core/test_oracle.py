"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

from newsquery import queries

FOLDER = "/root/testdata/sf0.001"
queries.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return None if v is None else round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == columns
    assert got == sorted(str([plain(dict(zip(rel.columns, r))[c]) for c in columns]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert len(df.columns) == len(set(df.columns)) and len(df.collect()) >= 0
