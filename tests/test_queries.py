"""Every registered query against its SQL, on the smallest tables."""

import compare
import pytest
from conftest import SMALL

from lodestone.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE_SQL:
        assert compare.differences(df, con, ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "usage_overview" in e.queries()
