import pytest
from conftest import SF
from oracle import spark_rows, sql_rows, views

import __spark_entry__
from questora.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, name):
    cols, rows = spark_rows(registry.QUERIES[name](spark, SF))
    if name in registry.ORACLES:
        assert (cols, rows) == sql_rows(views(SF), registry.ORACLES[name])
    else:
        assert cols and rows


def test_entry_and_oracle_names(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
