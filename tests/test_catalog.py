"""All registered queries of the library: those with SQL against DuckDB, the rest run and give rows."""

import pytest

from corvane.plans import catalog
from tests.compare import close, compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    got, expected = compare(spark, sf, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
    assert got[0] == expected[0]
    assert close(got[1], expected[1])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
