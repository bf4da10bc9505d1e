"""Every registered query runs, and agrees with its SQL where it has one."""

import pytest

from clipgraph.plans import catalog, check
from clipgraph.plans.registry import QUERIES

catalog.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert check.compare(name, spark, con, SF) == ""


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
