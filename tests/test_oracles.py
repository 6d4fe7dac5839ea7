"""Every registered query against its oracle text."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences
from tests.conftest import SF_DIR

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF_DIR) == []


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).take(1)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert 0 <= row.p_value <= 1


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
