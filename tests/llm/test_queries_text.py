import pytest

from factloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs(spark, small, name):
    df = registry.queries()[name](spark, small)
    assert df.columns and df.count() > 0
