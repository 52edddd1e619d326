"""Queries whose cohorts are so dense that the first fact of a day stands for all: nothing is
left for the newest hours' chart of output, and superseded facts alone are over half."""

import duckdb
import pytest
from test_queries import _rows

from gaugeworks.plans import catalog


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    path = tmp_path_factory.mktemp("dense")
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 1560) SECOND AS ts, i % 9 AS user_id, CASE WHEN i % 10 < 4 THEN 'purchase' WHEN i % 10 = 9 THEN 'error' ELSE 'view' END AS event_type,
        (i % 50)::DOUBLE AS value, '{{"k": ' || (i % 2)::VARCHAR || '}}' AS props FROM range(1661) AS t(i)) TO '{path}/events.parquet' (FORMAT parquet)""")
    return str(path)


@pytest.mark.parametrize("name", ["retention", "trend_snapshot", "trend_snapshot_filtered", "cell_texts"])
def test_dense(spark, dense, name):
    got = catalog.QUERIES[name](spark, dense).toPandas()
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{dense}/events.parquet'")
        want = db.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    if name.startswith("trend"):
        assert want["titles"].isna().any()
    assert _rows(got, columns) == _rows(want, columns)
