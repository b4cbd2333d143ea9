"""Queries of the operators that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from compare import connect, difference

from goldpan.llm import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(plans.ORACLES))
def test_query(spark, name):
    assert difference(plans.QUERIES[name](spark, FOLDER), connect(FOLDER), plans.ORACLES[name]) is None
