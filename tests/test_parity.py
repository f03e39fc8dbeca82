"""Every query with SQL gives the SQL's result on the smallest tables."""

import pytest

from tests.parity import connect, differences
from voxgrain.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, connection, name):
    assert differences(registry.queries()[name](spark, FOLDER), connection, registry.oracle_sql()[name]) == []


def test_sql_only_for_registered_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
