"""Every registered query against its DuckDB twin on sf0.001 (the driver
does the same at sf0.01); rows-only queries must run and return rows."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from aqlens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _bag(pdf):
    cols = sorted(pdf.columns)
    return cols, Counter(tuple(_norm(None if (not isinstance(x, str) and x != x) else x) for x in rec) for rec in pdf[cols].itertuples(index=False))


# the queries of the library proper; those of the training-data part have tests of their own
ORACLE = sorted(catalog.ORACLE)
ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.ORACLE))


@pytest.mark.parametrize("name", ORACLE)
def test_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF).toPandas()
    d = con.execute(E.oracle_sql()[name]).df()
    sc, sb = _bag(s)
    dc, db = _bag(d)
    assert sc == dc
    assert {c: str(s[c].dtype) for c in s.columns} == {c: str(d[c].dtype) for c in s.columns}
    assert len(s) == len(d)
    assert sb == db


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, name):
    assert E.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[:3] == ["city", "date", "aqi"]
