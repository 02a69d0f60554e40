"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest
from compare import connect, differences

from cadencekit.checks import registry

SF_DIR = "/root/testdata/sf0.001"
CHECKS = registry()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", CHECKS)
def test_query(spark, con, name):
    check = CHECKS[name]
    frame = check.run(spark, SF_DIR)
    if check.sql is None:
        assert frame.count() > 0
    else:
        assert differences(frame, con, check.sql) == []


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
