"""Every catalogue query with an SQL twin gives the same rows in both engines (smallest scale)."""
import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    ok, msg = compare(spark, con, entry.queries()[name], SQL[name], SF, allow_empty=True)
    assert ok, msg


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "p_ac_w" in df.columns
