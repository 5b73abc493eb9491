"""Registered queries against their SQL at the smallest scale; FORETRACE_ALL=1 takes all of them.

``python tests/compare.py [folder] [names]`` does the same at any scale.
"""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
import bench

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("FORETRACE_ALL") else [n for n in bench.HEADLINE if n in ORACLES]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], FOLDER) is None


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert set(bench.HEADLINE) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
