"""Every core query over empty tables and over tables with nulls in every column."""

import os

import pytest

import edges
from codeloom.plans import all_queries

BASE = os.environ.get("CODELOOM_TESTDATA", "/root/testdata/sf0.001")
ONE_ROW = {"stats_trend"}  # totals have a row even where there is nothing

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    empty, nulls = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("nulls")
    edges.write(BASE, empty, nulls)
    return str(empty), str(nulls)


@pytest.mark.parametrize("name", list(all_queries()))
def test_edges(spark, tables, name):
    query = all_queries()[name]
    assert query(spark, tables[0]).count() == (1 if name in ONE_ROW else 0)
    assert query(spark, tables[1]).count() >= 0
