"""Every registered query at the smallest scale against its SQL statement."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, duck, name):
    diff, n = compare(spark, duck, name, contract.queries()[name], ORACLES.get(name), FOLDER)
    assert diff is None, diff


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_statements_belong_to_queries():
    assert set(ORACLES) <= set(contract.queries())
