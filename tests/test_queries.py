"""Every registered query against its SQL."""

import os

import pytest

import __spark_entry__ as entry
from comparison import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


OWN = sorted(entry._QUERIES)


def test_every_query_has_sql():
    assert set(OWN) <= entry.queries().keys() & entry.oracle_sql().keys()


def test_flagship(spark):
    assert entry.entry(spark).columns == ["dst_project", "id", "label", "target_path"]


# The queries that read or write documents, which takes Python.
DOCUMENTS = {
    "q_blocked",
    "q_completed_plan",
    "q_delta_plan",
    "q_first_run",
    "q_plan_contents",
    "q_plan_files_only",
    "q_plan_summary",
    "q_rewrite_violations",
    "q_written_create",
    "q_xml_roundtrip",
}


@pytest.mark.parametrize("name", OWN)
def test_query(spark, oracle, name):
    """The result is that of the SQL, and the plan has no cross join or needless Python."""
    rows = entry.queries()[name](spark, SF_DIR)
    found = rows.collect()
    assert found, "a query should have something to show"
    assert differences(found, rows.columns, oracle.execute(entry.oracle_sql()[name])) == ""

    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in DOCUMENTS:
        assert "Python" not in plan and "MapInPandas" not in plan
