"""Each query with SQL gives what the SQL gives on the small tables, names and types of columns included."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v).replace("+00:00", "")
    return round(float(v), 6) + 0.0


def rows(found, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows(df.collect(), df.columns)
    if name not in SQL:
        assert got
        return
    want = connection.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(want.fetchall(), names)


def test_entry_has_rows(spark):
    if os.path.isdir(FOLDER):
        assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(entry.queries())


def test_bands_and_types_are_broadcast_and_filters_stay_in_one_stage(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")

    def plan(name):
        return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastNestedLoopJoin" in plan("band_lookup") and "Exchange hashpartitioning" not in plan("band_lookup")
    staged = plan("staged_pipeline")
    assert staged.count("Exchange hashpartitioning") == 1  # that of the mean of five types
    assert "Python" not in staged and "BroadcastHashJoin" in staged
