"""Every registered query runs on the small tables and equals its SQL."""

import pytest

from rankloom.catalog import QUERIES
from tests.conftest import SMALL
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    _, wrong = compare(spark, connection, QUERIES[name], SMALL)
    assert not wrong


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
