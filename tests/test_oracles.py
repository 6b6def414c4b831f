"""Every registered query runs; where there is an oracle, DuckDB gives the same rows."""

import pytest
from conftest import same_rows

from scriptoria.plans import registry


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    if name in registry.oracles():
        same_rows(got, duck.sql(registry.oracles()[name]).df())
    else:
        assert len(got)


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
