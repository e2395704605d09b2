"""Every query with SQL gives DuckDB's rows."""

import datetime

import duckdb
import pytest

from widecairn import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in own.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_same_rows(spark, duck, name):
    df, want = own.queries()[name](spark, SF), duck.sql(own.oracle_sql()[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [want.columns.index(n) for n in names]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(own.queries()) <= set(__spark_entry__.queries())
