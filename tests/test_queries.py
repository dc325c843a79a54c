"""Every query of the engine against its SQL, and those without SQL at least run with a stable schema."""

import pytest
from compare import connect, same

from millrace.plans import registry


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, folder, name):
    same(spark, con, folder, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, folder, name):
    found = registry.QUERIES[name](spark, folder)
    assert found.columns and found.count() >= 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
