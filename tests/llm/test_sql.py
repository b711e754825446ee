"""Corpus queries against DuckDB, where SQL can express them."""

import pytest

from hearsay.llm.queries import oracle_sql, queries
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    found = spark_rows(queries()[name](spark, sf_dir))
    assert found == duck_rows(duck, oracle_sql()[name])
    assert found[1]
