import pytest

from tessera import catalog
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.DATA.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, name):
    oracle.check(spark, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, str(oracle.DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
