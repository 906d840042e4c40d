"""Every query with an oracle, held against DuckDB over whole tables."""

import compare
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, sf_dir, name):
    ours, theirs = compare.both(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1
    assert "total_searches" in df.columns


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
