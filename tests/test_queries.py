"""Every registered query against its SQL check, on whole tables."""

import pytest
from compare import connect, difference

from folioflow.plans.registry import load_all

ENTRIES = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query_agrees(spark, con, sf, name):
    assert difference(spark, con, ENTRIES[name], sf) is None


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100
