"""Every library query against independently written SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from sparkloom.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "" if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted(str(tuple(map(cell, r))) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, sql, name):
    got = QUERIES[name](spark, folder).toPandas()
    if name in ORACLE_SQL:
        want = sql.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
