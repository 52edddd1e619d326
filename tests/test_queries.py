"""Every registered telemetry query against its SQL, on the smallest driver tables."""

import os

import duckdb
import pandas as pd
import pytest

from gaugeworks.plans import catalog as queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def _value(x):
    if isinstance(x, str):
        return x
    if hasattr(x, "__len__"):
        return str(list(x))
    return "null" if x is None or x is pd.NA or x != x else str(float(x))


def _rows(df, columns):
    return sorted(tuple(map(_value, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLES:
        assert len(got)
        return
    with duckdb.connect() as db:
        for file in sorted(os.listdir(SF)):
            db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
        want = db.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _rows(got, columns) == _rows(want, columns)
