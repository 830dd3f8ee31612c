"""Every registered query of the native operators against its SQL on the smallest tables."""

import duckdb
import pytest

from rasterloom.plans.catalog import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "events", "part"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    got = got[cols].sort_values(cols).reset_index(drop=True)
    want = want[cols].sort_values(cols).reset_index(drop=True)
    assert len(got) and got.equals(want)
