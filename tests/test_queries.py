"""Every registered query against its oracle SQL at the smallest scale."""

import pytest
from compare import connect, difference
from conftest import DATA

from flagstone.catalog import load_all

ENTRIES = load_all()


@pytest.fixture(scope="session")
def oracle():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(name, tables, oracle):
    entry = ENTRIES[name]
    df = entry.run(tables)
    if entry.sql is None:
        assert df.count() > 0
    else:
        assert difference(df, oracle, entry.sql) is None
