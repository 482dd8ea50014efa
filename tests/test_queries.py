import pytest
from oracle import SF, assert_same

from scrivana.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert_same(df, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
