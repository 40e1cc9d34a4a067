"""Queries of the llm subpackage that SQL can express."""

import os

import oracle
import pytest

from cairn.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    faults = oracle.compare(spark, oracle.connect(FOLDER), queries.QUERIES[name], queries.SQL[name], FOLDER)
    assert not faults, faults
