import pytest

from tessella.plans import catalog

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, oracle):
    assert rows_of(catalog.queries()[name](spark, sf_dir)) == oracle(catalog.oracle_sql()[name])


def test_flagship_pushes_columns_down(spark, sf_dir):
    df = catalog.flagship(spark, sf_dir)
    assert df.count() > 0
    assert "p_retailprice" not in df._jdf.queryExecution().executedPlan().toString()


def test_entry_point_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
