"""Every registered relational query against its DuckDB twin."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewater.operators import catalogue, state_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.QUERIES | state_queries.QUERIES, catalogue.ORACLE | state_queries.ORACLE
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (bool, str)):
        return v
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert canonical(got) == canonical(con.sql(ORACLE[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
