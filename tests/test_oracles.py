"""Every query next to its SQL, on the smallest tables."""

import pytest

from graphloom.plans import registry
from tests.oracle import difference

SF = "/root/testdata/sf0.001"
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    assert difference(Q[name](spark, SF), SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, name):
    df = Q[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)
