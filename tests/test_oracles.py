"""Every registered query against its DuckDB oracle on the smallest scale
factor: same column names, same row count, same values (order-insensitive,
floats compared at 6 decimals)."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from vellum.sources.tables import BASE_TABLES

QUERIES = E.queries()
ORACLES = E.oracle_sql()


def _canon(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    return str(v)


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_canon(r[i]) for i in order) for r in records)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    # whatever else is in the catalog must not change an oracle
    con.execute("create view unrelated as select 'x' as text, 'y' as lang, 1 as item_id")
    return con


def test_every_query_registered_has_a_callable():
    assert len(QUERIES) >= 100
    assert set(ORACLES) <= set(QUERIES)
    # only training-data operators that SQL can't express go without
    assert all(re.match(r"op\d+_|pipeline$", q) for q in set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_small, duck, name):
    df = QUERIES[name](spark, sf_small)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert _rows(df.columns, got) == _rows(ocols, want)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_evaluations"] > 0
