"""Every query with a SQL equivalent against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    return v.isoformat().replace("T00:00:00", "") if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(shown, r)) for r in df.select(*columns).collect()), key=str)
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert got == sorted((tuple(shown(r[i]) for i in order) for r in result.fetchall()), key=str)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"country", "day", "class4_share"} <= set(df.columns)
