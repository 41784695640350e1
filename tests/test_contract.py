import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from contract.compare import compare, duck

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


def test_names():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 100


@needs_data
def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "target_forward_return" in df.columns


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@needs_data
@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_oracle(spark, con, name):
    line = compare(spark, con, name, SF, queries()[name], oracle_sql().get(name))
    assert line.startswith(("ok", "rows")), line
