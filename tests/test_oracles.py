from __future__ import annotations

import pytest
from compare import duck_rows, spark_rows

from wirepost.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    got = spark_rows(catalog.QUERIES[name](spark, sf_dir))
    if name in catalog.ORACLES:
        assert got == duck_rows(duck, catalog.ORACLES[name])
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
