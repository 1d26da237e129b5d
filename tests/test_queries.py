"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from oracle import rows, sql_rows

from orrery.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.columns
        got.collect()
        return
    names, want = sql_rows(sql, SF)
    assert sorted(got.columns) == names
    assert rows(got) == want


def test_entry_works_without_the_optional_part(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1
