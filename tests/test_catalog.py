"""Every registered query with SQL gives the same rows as DuckDB, and the others give rows."""

import pytest
from conftest import DATA, rows_of

from foliospark import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, DATA).toPandas()
    if name in catalog.oracle_sql():
        wanted = duck.execute(catalog.oracle_sql()[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)
    else:
        assert len(found)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
