"""Every query with SQL against DuckDB on the smallest tables; every other one runs and has rows."""

import oracle
import pytest

from quillwave.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    if name in registry.ORACLE_SQL:
        assert oracle.compare(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""
    else:
        assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
