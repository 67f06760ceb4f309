"""Every registered query against its DuckDB oracle at sf0.001."""

import pytest

import __spark_entry__ as E
from furlong.plans import registry
from tests.oracle_check import check, duck

SF = "/root/testdata/sf0.001"
KEYS = list(registry.QUERIES)   # tests/llm has its own


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = check(spark, con, key, SF, E.queries()[key], E.oracle_sql().get(key))
    assert r["ok"] is not False, r
    assert r["spark_rows"] >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "analysis_score" in df.columns
