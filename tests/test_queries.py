import pytest
from compare import SF, assert_same

from cloakframe.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert_same(catalog.queries()[name](spark, SF), duck, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
