"""Every query of the package with SQL, against DuckDB on the same tables."""

import os

import pytest

from linestream.llm.queries import ORACLE, QUERIES
from scripts.check_oracle import oracle_rows, rows_of

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cols, want = oracle_rows(SF, ORACLE[name])
    assert sorted(cols) == sorted(df.columns)
    assert got == want and got
