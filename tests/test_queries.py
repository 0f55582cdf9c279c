"""Every registered query against its DuckDB oracle at the smallest scale."""

import os

import pytest
from compare import connect, differences
from test_plans import plan_of

from __spark_entry__ import entry, oracle_sql, queries
from sitefold.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    plan = plan_of(df)
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan
    problem, rows = differences(spark, duck, name, SF_DIR, df)
    assert problem is None and rows > 0


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["page_id", "path", "content"] and result.count() == 50
