"""Every query against its SQL statement on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql
from check import compare, connect
from spendframe.plans.queries import QUERIES
from tests.conftest import SF

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    problem, rows = compare(spark, con, name, SF)
    assert problem is None
    # A sparse scale may flag nothing; everything else must have rows.
    assert rows > 0 or name.startswith(("D0", "D1"))


def test_every_query_has_a_statement():
    assert set(NAMES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 1
