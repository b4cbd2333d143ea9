"""Every registered query against its checking SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import connect, difference

from goldpan.plans import load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()
# Nothing of the kind exists in the smallest tables.
MAY_BE_EMPTY = {"d08_no_result_statement", "c14_split_share"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    if name not in ORACLES:
        assert frame.count() > 0
        return
    problem = difference(frame, duck, ORACLES[name])
    if problem == "no rows" and name in MAY_BE_EMPTY:
        return
    assert problem is None, problem


def test_entry(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert {r["system"] for r in rows} == {"greedy", "vote"}
    assert set(contract.oracle_sql()) <= set(contract.queries())
