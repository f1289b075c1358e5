"""Every query of the engine runs, and gives what its SQL gives."""

import pytest

from docloom import registry

from .compare import DATA, same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    same(registry.QUERIES[name](spark, DATA), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns and len(df.collect()) >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_plans(spark):
    """Queries that SQL can express stay in the JVM but for the cache's own rule."""
    for name in ("a18_j18_a13_pair_hist", "j20_as_of", "w05_d07_rolling_entrants", "g07_cycling"):
        plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan


def test_columns_are_pruned(spark):
    plan = registry.QUERIES["a20_additional"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan
