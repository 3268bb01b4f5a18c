"""Plan assertions: built-in expressions only, claims scanned once per mart."""

import re

import pytest

from rosterkit.plans.queries import REGISTRY

SF_SMALL = "/root/testdata/sf0.001"

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF", "InArrow")
# records whose quoted fields hold line breaks are cut in tasks
PYTHON_READERS = {"quoted_records_via_files"}
SINGLE_CLAIMS_PASS = ["roster", "worklist", "completion_summary", "monthly_completions", "fy_summary",
                      "priority_crosstab", "narrative_metrics",
                      "trailing_months", "set_overlap", "coverage_gap"]


def _plan(spark, name):
    return REGISTRY[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_python_in_plan(spark, name):
    plan = _plan(spark, name)
    assert name in PYTHON_READERS or not any(n in plan for n in PYTHON_NODES), name


@pytest.mark.parametrize("name", SINGLE_CLAIMS_PASS)
def test_claims_scanned_once(spark, name):
    assert len(re.findall(r"FileScan parquet \[l_orderkey", _plan(spark, name))) == 1


@pytest.mark.parametrize("name", ["reconcile_counts", "reconcile_missing", "id_intersect"])
def test_shared_roster_is_cut(spark, name):
    assert "l_orderkey" not in _plan(spark, name)


def test_marts_read_the_checkpointed_roster(spark):
    from rosterkit.plans.flows import Run
    run = Run(spark, SF_SMALL)
    before = run.summary
    run.checkpoint_roster()
    assert run.summary is not before
    for mart in (run.summary, run.worklist, run.monthly, run.crosstab(), run.narrative()):
        assert "l_orderkey" not in mart._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark):
    plan = _plan(spark, "roster")
    scan = re.search(r"FileScan parquet \[(l_[^\]]*)\]", plan).group(1)
    assert "l_extendedprice" not in scan and "l_comment" not in scan


def test_id_cleaning_not_duplicated_into_claims_join(spark):
    """The NULL-id filter must not be inlined (with the id cleaning) into the claim-line joins."""
    plan = _plan(spark, "roster")
    claims_joins = [ln for ln in plan.splitlines() if ("BroadcastHashJoin" in ln or "SortMergeJoin" in ln)
                    and re.search(r"\[(l|o|s|n)_\w+#", ln)]
    assert claims_joins and not any("regexp_replace" in ln for ln in claims_joins)


def test_roster_exchanges_bounded(spark):
    """One hash shuffle per input family (claims pairs, person spine, deferrals, admissions x2), none after the spine."""
    plan = _plan(spark, "roster")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 6
    assert len(re.findall(r"Exchange hashpartitioning\(MEDICAID_ID#\d+, \d+\)", plan)) <= 1
