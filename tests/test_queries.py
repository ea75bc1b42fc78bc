"""Registered queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from manygrain.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(frame):
    import pandas as pd

    columns = sorted(frame.columns)
    one = lambda v: "" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    cells = lambda v: one(v) if not str(v).replace(".", "", 1).isdigit() else f"{float(v):.6f}"
    return columns, sorted(tuple(cells(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    assert plain(QUERIES[name](spark, DATA).toPandas()) == plain(con.sql(ORACLES[name]).df())
