"""Every query against DuckDB on the same tables."""

import pytest

import __spark_entry__ as contract
from hearsay.checks.oracles import oracle_sql
from hearsay.checks.queries import queries
from tests.compare import duck_rows, spark_rows

QUERIES = queries()
ORACLES = oracle_sql()


#: Fitted by iteration; tests/test_learned.py measures them on texts that were held out.
FITTED = {"fitted_verdicts", "fitted_quality"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | FITTED
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected_rows = duck_rows(duck, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected_rows
    assert rows


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
