"""All operators are registered, and those with SQL give DuckDB's rows."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_names():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted({n.split("_")[0] for n in names}, key=lambda n: (len(n), n)) == [*(f"op{k}" for k in range(1, 10)), "op10", "pipeline"]
    assert len(names) == 11


@pytest.mark.parametrize("name", ["op1_mixing", "op2_jaccard_join", "op7_lm_score", "op9_hnsw", "fingerprint_texts", "pii_base_spans"])
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(__spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)
