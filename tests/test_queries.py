import pytest

from helixmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_equals_sql(same, name):
    assert same(catalog.QUERIES[name], catalog.ORACLE[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
