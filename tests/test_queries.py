"""Every query with SQL to check it equals that SQL on the given tables."""

import pytest

import __spark_entry__ as entry
from oracle import assert_same

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.dtypes == [("id", "bigint"), ("fruit", "string"), ("total", "double")]
    assert df.count() > 0
