"""Every registered query of the core against its SQL on the smallest tables."""

import pytest

from tidegate.queries import connectors, engine, problems

ORACLES = {**engine.ORACLE, **connectors.ORACLE, **problems.ORACLE}
QUERIES = {**engine.QUERIES, **connectors.QUERIES, **problems.QUERIES}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, compare):
    compare(QUERIES[name], ORACLES[name])


def test_every_sql_has_its_query():
    assert not set(ORACLES) - set(QUERIES)


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(entry.queries())
