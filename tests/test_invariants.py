"""SURVEY 5 invariants on the sf0.01 stand-in run."""

import pytest
from pyspark.sql import functions as F

from rosterkit.operators.cohorts import ID
from rosterkit.plans.flows import Run

SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def run(spark):
    r = Run(spark, SF_MID)
    r.persist_roster()
    return r


def test_roster_ids_not_null_and_rows_distinct(run):
    r = run.roster
    assert r.where(F.col(ID).isNull()).count() == 0
    assert r.count() == r.distinct().count()


def test_worklist_subset_and_one_rank_per_person(run):
    w = run.worklist
    assert w.select(ID).subtract(run.roster.select(ID)).count() == 0
    assert w.groupBy(ID).agg(F.count_distinct("n_priority").alias("k")).where("k > 1").count() == 0


def test_summary_arithmetic_and_total(run):
    rows = run.summary.collect()
    total = [x for x in rows if x.is_total == 1][0]
    parts = [x for x in rows if x.is_total == 0]
    for col in ("eligible", "due_in_fy", "deferred", "completed_elig", "overdue"):
        assert total[col] == sum(p[col] for p in parts)
    for x in rows:
        assert x.numerator == x.completed_elig - x.overdue
        assert x.completed_inel == 0


def test_flags_consistent(run):
    r = run.roster
    assert r.where(F.col("sis_overdue") & F.col("sis_coming90")).count() == 0
    floor = run.cfg.due_floor
    assert r.where(F.col("due_by_dt") < F.lit(floor)).count() == 0


def test_overlap_monotone(run):
    sizes = {x.mask: x.size for x in run.overlap().collect()}
    for sup, n in sizes.items():
        for sub in sizes:
            if sub & sup == sub:
                assert sizes[sub] >= n
