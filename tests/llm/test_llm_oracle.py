"""The operators' queries against their SQL twins, over whole tables."""

import duckdb
import pytest

from tests.conftest import SF_MID, TABLES
from textpairs.llm.queries import ORACLE, QUERIES
from tools.check_oracle import digest


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_MID}/{t}.parquet')")
    df = QUERIES[key](spark, SF_MID)
    res = con.execute(ORACLE[key])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, res.fetchall())[0]
