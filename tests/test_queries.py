"""Every registered query with SQL agrees with DuckDB; the others give rows."""

import compare
import pytest

from plumbline import registry

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = compare.spark_rows(registry.queries()[name](spark, compare.SF))
    if name in ORACLE:
        assert got == compare.oracle(ORACLE[name])
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
