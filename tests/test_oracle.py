"""Every core query against its SQL on the smallest tables; plans that must stay as they are."""

import os

import pytest

import oracle
from codeloom.plans import all_queries, all_sql, flagship

BASE = os.environ.get("CODELOOM_TESTDATA", "/root/testdata/sf0.001")
QUERIES, SQL = all_queries(), all_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    mine, want = oracle.rows(spark, BASE, QUERIES[name], SQL.get(name))
    assert len(mine.columns) > 0
    if want is not None:
        assert not oracle.same(mine, want)


def test_flagship(spark):
    assert flagship(spark, BASE).count() == 10


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_threshold_stays_above_the_cut(spark):
    p = plan(QUERIES["vector_topk_threshold"](spark, BASE))
    assert "TakeOrderedAndProject" in p and p.index("Filter") < p.index("TakeOrderedAndProject")


def test_columns_are_pruned(spark):
    p = plan(QUERIES["call_edges"](spark, BASE))
    assert "snippet" not in p and "docstring" not in p


@pytest.mark.parametrize(("name", "scans", "shuffles"), [("package_stats", 2, 6), ("p3_found", 3, 2), ("compare_patterns", 2, 5), ("scan_declarations", 1, 1), ("scan_spans", 2, 4), ("dir_rollup", 1, 3)])
def test_scans_and_shuffles(spark, name, scans, shuffles):
    """How often a query reads a table and shuffles, in what is left to run of it."""
    p = plan(QUERIES[name](spark, BASE))
    assert p.count("FileScan") <= scans and p.count("Exchange hashpartitioning") + p.count("Exchange rangepartitioning") <= shuffles, p
