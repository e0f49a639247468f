"""Every registered query against its SQL, and the entry point."""

import pytest
from compare import database, difference

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    found, _ = difference(spark, con, QUERIES[name], ORACLE[name], sf_dir)
    assert found is None, found


def test_entry(spark):
    counts = {r.severity: r.n for r in entry.entry(spark).collect()}
    assert len(counts) == 5 and sum(counts.values()) > 0
