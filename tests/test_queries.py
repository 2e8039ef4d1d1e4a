import pytest

from siltbed.plans import registry
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf, name):
    assert_same(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    keys = [r.key for r in out.select("key").collect()]
    assert keys and keys == sorted(keys)
    assert set(registry.queries()) <= set(__spark_entry__.queries())
