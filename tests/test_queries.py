"""Every registered query beside its SQL form in DuckDB, on the smallest scale."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from corpuslab.plans import load

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KEYS = list(load().QUERIES)
# Queries whose rule has no SQL form.
ROWS_ONLY = {"knn_lsh", "knn_coded", "value_links", "value_links_loose", "value_contents"}


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for table in TABLES:
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return c


def test_keys_fit():
    assert set(load().ORACLES) == set(KEYS) - ROWS_ONLY and set(KEYS) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, folder, con, key):
    df = entry.queries()[key](spark, folder)
    columns = sorted(df.columns)
    rows = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if key in ROWS_ONLY:
        assert rows
        return
    res = con.sql(entry.oracle_sql()[key])
    assert sorted(res.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert Counter(map(tuple, con.sql(f"SELECT {picked} FROM res").fetchall())) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
