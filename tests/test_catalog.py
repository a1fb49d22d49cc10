"""Every query with SQL gives the same rows in Spark and DuckDB, over the whole small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from inkwell.plans.catalog import QUERIES, SQL, flagship


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, tables, name):
    df = QUERIES[name](spark, data)
    result = tables.execute(SQL[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr([value(r[cols.index(c)]) for c in sorted(cols)]) for r in result.fetchall())
    got = sorted(repr([value(r[c]) for c in sorted(cols)]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0


def test_flagship(spark, data):
    assert flagship(spark, data).columns == ["tier", "articles", "chunks", "words"]
