import pytest

from tessella.llm import registry

from ..conftest import rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, spark, sf_dir, oracle):
    assert rows_of(registry.QUERIES[name](spark, sf_dir)) == oracle(registry.ORACLES[name])
