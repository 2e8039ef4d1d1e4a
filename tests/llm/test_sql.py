"""Every query that SQL can express, on the driver's small tables, on the hand-made cases, and on empty tables."""

import pytest

from siltbed.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_driver_tables(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_hand_cases(spark, cases, name):
    assert_same(QUERIES[name](spark, cases), ORACLES[name], cases)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0
