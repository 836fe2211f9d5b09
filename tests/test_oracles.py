import pytest

from taleweave import catalog, plans  # noqa: F401
from tests.comparing import assert_same, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_oracle(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
