"""Every registered query against its SQL, on the smallest tables."""

import pytest

from tests.oracle_check import compare, connect
from vocara.plans.oracle import ORACLE
from vocara.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) is None


def test_names_match():
    assert set(ORACLE) <= set(QUERIES)
