"""Every registered query against its SQL in DuckDB on the same tables; those without SQL return rows."""

import glob
import math
import os
from collections import Counter

import pandas as pd
import pytest

from larkspur import registry

from .conftest import SF

ALL = registry._all()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if sql])
def test_query_equals_sql(spark, duck, name):
    fn, sql = ALL[name]
    df = fn(spark, SF)
    cols = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    q = duck.execute(sql)
    names = [c[0] for c in q.description]
    assert sorted(names) == cols
    want = Counter(repr([plain(r[names.index(c)]) for c in cols]) for r in q.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n, (_, sql) in ALL.items() if not sql])
def test_query_returns_rows(spark, name):
    assert ALL[name][0](spark, SF).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0
