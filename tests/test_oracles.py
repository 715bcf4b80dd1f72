"""Every registered query against its DuckDB oracle on sf0.001 (the same
check the driver makes at sf0.01)."""

import hashlib
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "documents", "pages", "benchmark", "labels", "conversations"]


def _digest(df):
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(None if v != v else v for v in r)) if False else repr(r)
                  for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


import __spark_entry__ as E  # noqa: E402

NAMES = sorted(E.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    odf = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert len(sdf) == len(odf)
    assert _digest(sdf) == _digest(odf)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "citation" in df.columns
