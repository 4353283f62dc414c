"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tidegrid.plans import catalog

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    if not Path(DIR).is_dir():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for p in sorted(Path(DIR).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, oracle, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    got = oracle.execute(catalog.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=str)
    assert mine == theirs


def test_registry_is_whole():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
