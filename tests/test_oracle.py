"""Every registered query against its SQL twin, and the shape of its plan."""

import pytest

from tests.oracle import compare, connect
from verdictframe.plans import load

REGISTRY = load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(name, spark, sf_dir, con):
    df = REGISTRY.QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name in REGISTRY.ORACLES:
        assert compare(name, df, REGISTRY.ORACLES[name], con) is None
    else:
        assert len(df.collect()) > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 9
