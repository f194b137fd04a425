import pytest
from oracle import both, connect

from panelspark.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, small, con, name):
    got, want = both(spark, small, QUERIES[name], ORACLES[name], con)
    assert got == want


def test_every_query_runs(spark, small):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, small).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
