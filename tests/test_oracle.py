"""Every registered query against its SQL, and the entry points."""

import oracle
import pytest

import __spark_entry__ as entry
from workload import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLE[name], sf) is None


def test_entry_points(spark):
    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
