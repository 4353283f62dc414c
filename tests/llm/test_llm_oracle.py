"""Each query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidegrid.llm import queries

DIR = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(round(v, 6) + 0.0)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    if not DIR.is_dir():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, str(DIR))
    got = con.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str) == theirs
