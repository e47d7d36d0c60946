"""Every query with SQL of its own against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from corpusloom.plans import catalogue
from tests import cases

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.8g}")
    return str(value)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, con, name):
    compared(catalogue.QUERIES[name](spark, TABLES), con.execute(catalogue.ORACLES[name]))


def compared(df, run):
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in run.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(cases.CASES))
def test_cases_by_hand(spark, con, name):
    compared(cases.CASES[name](spark, None), con.execute(cases.ORACLES[name]))


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
