"""Findings of round 3: extracts are built once, claims are cleaned once, sets and changes take one pass."""

import pytest

from pyspark.sql import functions as F

from rosterkit import functions as rf
from rosterkit.functions import dates, ids
from rosterkit.operators import changes, overlap
from rosterkit.plans import queries

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["summary_from_paths", "services_via_files", "incremental_services"])
def test_extract_files_read_a_table_not_the_extract_anew(spark, monkeypatch, name):
    plans, write = [], queries._extract_files
    monkeypatch.setattr(queries, "_extract_files", lambda df, *a: (plans.append(_plan(df)), write(df, *a))[1])
    queries.REGISTRY[name](spark, DATA)
    assert plans and not [p for p in plans if "Join" in p or "Aggregate" in p]


def test_row_changes_does_not_sort_for_its_states(spark):
    d = spark.createDataFrame([("1", "A", "x", 1), ("1", "A", "y", 2), ("2", "A", None, 1)], "MEDICAID_ID string, PROVIDER_NAME string, status string, n int")
    df = changes.row_changes(d, d.where("n = 1"))
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.MEDICAID_ID, r.kind, r.n_before, r.n_after, r.status_before, r.status_after) for r in df.collect()] == [("1", "status", 2, 1, "x,y", "x")]


def test_semi_join_cleans_ids_once(spark):
    filters = [line for line in _plan(queries.REGISTRY["semi_join"](spark, DATA)).splitlines() if "Filter" in line]
    assert not [line for line in filters if "regexp" in line or "RLIKE" in line]


def test_set_overlap_many_keeps_no_table_of_members(spark):
    plan = _plan(queries.REGISTRY["set_overlap_many"](spark, DATA))
    assert "LogicalRDD" not in plan and "Union" not in plan


@pytest.mark.parametrize("most", [1, 2, 3])
@pytest.mark.parametrize("count_null_id", [False, True])
def test_members_in_one_table_equal_sets(spark, most, count_null_id):
    rows = [("a", 1), ("a", 2), ("a", 2), ("a", 32), ("b", 3), ("c", 0), (None, 33), ("d", 1 << 6), ("d", 36)]
    member = spark.createDataFrame(rows, "id string, mask long")
    sets = [(str(i), member.where(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0), "id") for i in range(6)]
    own = overlap.set_overlap(spark, sets, count_null_id, zeros=False)
    got = overlap.set_overlap(spark, [s[0] for s in sets], count_null_id, zeros=False, most=most, members=(member, "id", "mask"))
    want = {(r.mask, r.label, r.size) for r in own.collect() if bin(r.mask).count("1") <= most}
    assert {(r.mask, r.label, r.size) for r in got.collect()} == want


def test_usual_forms_equal_the_steps(spark):
    texts = ["1", "0", "0000000000", "123456789012345", " MI123 ", "ID-5", "12A", "1 2", "A 12", "\t7", "12\n", "+5", "A-5-B", "A5B6", "١٢", "N/A", "", "  ",
             "$5", "A          12345678", "é12", "12é", "a--12--b  ", "- 12", "1999-01-05", "1999-1-5", "1/5/1999", "1/5/99", "1/5/69", "1/5/68", "2/29/1999",
             "2/29/00", "13/1/1999", "0000-01-01", "1/1/0000", "1999-01-05\n", " 1999-01-05", "1/5/99\n", "+12345-1-1", "-1999-1-1", "1999-001-05", "1999-01",
             "1999-01-05 00:00:00", "1999/01/05", "1/5/199", "٢/5/1999", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", rf.normalize_id("t").alias("i"), ids.normalize_id_by_steps("t").alias("i0"),
        rf.parse_mixed_date("t").alias("d"), dates.parse_mixed_date_by_pattern("t").alias("d0"))
    assert d.where("NOT (i <=> i0) OR NOT (d <=> d0)").collect() == []
