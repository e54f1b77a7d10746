"""Every query against its SQL; queries without SQL give rows. No plan has a nested-loop join."""

import pytest
from support import DATA

from strideframe.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(name, spark):
    """Their rows are checked against plain readings in test_golden.py and test_rules.py."""
    df = registry.queries()[name](spark, DATA)
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
