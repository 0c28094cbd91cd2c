"""Every registered query against its SQL; every plan free of all-pairs joins."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, compare, connect

SF = os.environ.get("TEST_SF", "0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(f"{DATA}/sf{SF}")


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    df = QUERIES[key](spark, f"{DATA}/sf{SF}")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if key in SQL:
        assert compare(df, con, SQL[key]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["customer_id", "customer", "documents", "units", "amount"]
    assert df.count() > 0
