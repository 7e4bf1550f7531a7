"""Every registered query against its SQL, on the given tables."""

import pytest
from pathlib import Path

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, duck

SF_DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    verdict, count, _ = compare(spark, connection, name, SF_DIR)
    assert verdict == ("equal" if name in oracle_sql() else "rows only")
    assert count > 0


def test_entry(spark):
    assert entry(spark).columns == ["data_year", "nativity", "n", "pop", "crude_rate", "age_adjusted_rate"]


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())
