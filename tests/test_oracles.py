"""Every registered query with a SQL twin, against DuckDB; the others must run."""

import pytest
from compare import connect, run_pair

from marklake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    ok, note, _ = run_pair(spark, con, name, registry.QUERIES[name], registry.ORACLES.get(name), SF)
    assert ok is not False, note


def test_entry_is_lazy_and_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
