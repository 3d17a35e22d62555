"""Every registered query that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from slidespark.registry import ORACLE_SQL, QUERIES, flagship

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = db.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False)) for df in (got, want))
    assert a == b


def test_flagship(spark):
    assert flagship(spark, SF).count() == 9 * 64
