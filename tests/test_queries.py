import pytest

from tessera.plans import catalogue
from tests.conftest import same


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, small, duck, name):
    same(catalogue.queries()[name](spark, small), duck, catalogue.oracle_sql()[name])


def test_entry_runs(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
