"""Every registered query against its DuckDB oracle on the smallest test tables
(row count, column names, order-insensitive value hash), as the driver does."""

import pytest

from tests.conftest import SF_SMALL
from tools.check_oracle import _same_type, digest

import __spark_entry__ as E
from textpairs.plans.registry import ORACLE, QUERIES, load_all

load_all()


def test_every_query_is_registered_with_an_oracle_or_documented_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only == {"tokenise_corpus", "decode_corpus", "roundtrip_audit"}
    assert set(ORACLE) <= set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["split", "label", "n"]
    assert sum(r.n for r in rows) > 0


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    dtypes = {d[0]: str(d[1]) for d in res.description}
    for f in df.schema.fields:
        assert _same_type(f.dataType.simpleString(), dtypes[f.name]), (f.name, f.dataType, dtypes[f.name])
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
