"""Every catalog query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from shelfline.plans import catalog
from verification import oracle
from verification.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
STATEMENTS = oracle.statements()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    if name in STATEMENTS:
        assert difference(df, duck, STATEMENTS[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as contract
    assert contract.entry(spark).count() == 200
    assert set(contract.oracle_sql()) <= set(contract.queries())
