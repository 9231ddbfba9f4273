"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _cell(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return f"{float(v):.6g}"
    return str(v)


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(map(_cell, r)) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert _rows(catalog.QUERIES[name](spark, DATA).toPandas()) == _rows(duck.execute(catalog.ORACLES[name]).df())


def test_entry_names_agree(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    out = {r.truth: r for r in entry.entry(spark).collect()}["supported_failure"]
    assert (out.total, out.covered, out.never_attempted) == (11, 1, 1)
    assert math.isclose(out.wilson_low, 0.016232)


def test_bootstrap_is_the_same_each_time(spark):
    a, b = (catalog.QUERIES["grouped_bootstrap"](spark, DATA).first() for _ in range(2))
    assert a == b and 0 <= a.low <= a.high <= 1
