"""Every registered query of the engine's own operators against its SQL."""

import pytest

from glosswork.plans import roster

from .oracle import connect, differences



@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(roster.oracle_sql()))
def test_equals_sql(spark, sf, con, name):
    assert differences(roster.queries()[name](spark, sf), con, roster.oracle_sql()[name]) == []


def test_all_have_sql():
    assert set(roster.queries()) == set(roster.oracle_sql())


def test_entry(spark, sf):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() == 3 and "total" in out.columns
    assert set(roster.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
