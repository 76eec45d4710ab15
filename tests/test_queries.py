"""Every registered query of the library's own operators against its SQL, on the small tables."""

from __future__ import annotations

import pytest

from folioweave.jobs import registry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert difference(df, con, registry.ORACLES[name]) == ""
    else:
        assert df.count() >= 0


def test_entry_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES
    assert set(registry.ORACLES) <= set(registry.QUERIES)
