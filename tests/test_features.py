"""Level dictionaries, incremental loads, timelines, many sets, sketches, run differences and dense months."""

from __future__ import annotations

import datetime as dt
import itertools
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rosterkit.config import Inputs, Source
from rosterkit.operators import levels, overlap, reports, sketches, timeline
from rosterkit.operators.changes import change_counts, row_changes
from rosterkit.operators.cohorts import ID
from rosterkit.plans.flows import Run
from rosterkit.sources import incremental
from tests.conftest import SF_SMALL


def _rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=repr)


# -- C12, C17 -----------------------------------------------------------------------

def test_levels_are_dense_and_ordered(spark):
    r = random.Random(1)
    values = ["b", "a", "Z", "é", "", " a", "10", "9", None]
    rows = [(i, r.choice(values), r.choice(["x", None, "y"])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(5)
    coded, table = levels.encode_levels(df)
    assert coded.columns == ["i", "a_code", "b_code"]
    want = {c: sorted({x[k] for x in rows} - {None}, key=lambda v: v.encode()) for k, c in ((1, "a"), (2, "b"))}
    assert _rows(table, "column", "code", "level") == sorted(((c, i + 1, v) for c, vs in want.items() for i, v in enumerate(vs)), key=repr)
    code = {(c, v): i + 1 for c, vs in want.items() for i, v in enumerate(vs)}
    assert _rows(coded) == sorted(((i, code.get(("a", a)), code.get(("b", b))) for i, a, b in rows), key=repr)
    # fewer rows use fewer levels; the codes become dense again and keep their order
    few = coded.where("a_code > 3")
    kept = levels.drop_levels(table, few, {"a": "a_code"})
    used = [v for v in want["a"][3:] if any(x[1] == v for x in rows)]
    assert _rows(kept, "old_code", "code", "level") == sorted(((code["a", v], i + 1, v) for i, v in enumerate(used)), key=repr)
    new = levels.recode_levels(few, kept, {"a": "a_code"})
    assert new.columns == coded.columns and {x.a_code for x in new.collect()} == set(range(1, len(used) + 1))


def test_levels_given_and_empty(spark):
    df = spark.createDataFrame([("a",), ("q",), (None,)], "a string")
    _, table = levels.encode_levels(spark.createDataFrame([("a",), ("b",)], "a string"))
    assert _rows(levels.encode_levels(df, ["a"], table)[0]) == [(1,), (None,), (None,)]
    coded, none = levels.encode_levels(df.where("false"))
    assert coded.count() == 0 and none.count() == 0


# -- S4, S8 --------------------------------------------------------------------------

def test_incremental_loads(spark, tmp_path):
    src, store = tmp_path / "in", f"{tmp_path}/store"
    (src / "closed").mkdir(parents=True)
    put = lambda name, *rows: (src / name).write_text("\n".join(["Report", "k,v", *rows]) + "\n")
    paths = [f"{src}/closed/*.csv", f"{src}/*.csv"]
    put("closed/a.csv", "1,x", "2,y")
    put("closed/b.csv", "3,z")
    put("c.csv", "4,x")
    load = lambda: incremental.load_new(spark, paths, store, skip=1)
    assert load() == 3 and load() == 0
    put("d.csv", "5,new", "6,new")
    assert load() == 1
    assert _rows(incremental.loaded(spark, store)) == [("1", "x"), ("2", "y"), ("3", "z"), ("4", "x"), ("5", "new"), ("6", "new")]
    assert incremental.manifest(spark, store).agg(F.count_distinct("load")).first()[0] == 2
    # rows of a load that failed before its manifest count nowhere, and its file is read again
    spark.createDataFrame([("9", "lost", f"file://{src}/e.csv")], "k string, v string, source_file string").write.parquet(f"{store}/data/load=failed")
    put("e.csv", "7,e")
    assert load() == 1 and incremental.loaded(spark, store).where("v = 'lost'").count() == 0
    # a changed file replaces its rows
    put("c.csv", "4,changed now", "44,more")
    assert load() == 1
    full = incremental.loaded(spark, store)
    assert _rows(full.where("k like '4%'")) == [("4", "changed now"), ("44", "more")] and full.count() == 8
    audit = {x.path.rsplit("/", 1)[-1]: x.rows for x in incremental.audit(spark, store).collect()}
    assert audit == {"a.csv": 2, "b.csv": 1, "c.csv": 2, "d.csv": 2, "e.csv": 1}


# -- M16, M18 -------------------------------------------------------------------------

def test_timeline_equals_the_summary_at_each_date(spark):
    run = Run(spark, SF_SMALL)
    days = [dt.date(1996, 2, 29), dt.date(1998, 9, 30), run.cfg.as_of]
    got = run.summary_timeline(days)
    for day in days:
        one = Run(spark, SF_SMALL, replace(run.cfg, as_of=day, fy_cutoff=day)).fy_summary
        want = one.where("PROVIDER_NAME IS NOT NULL OR is_total = 1")
        assert _rows(got.where(F.col("run_date") == F.lit(day)).drop("run_date"), *want.columns) == _rows(want)


def test_month_ends():
    assert timeline.month_ends(dt.date(1999, 11, 30), dt.date(2000, 2, 29)) == [
        dt.date(1999, 11, 30), dt.date(1999, 12, 31), dt.date(2000, 1, 31), dt.date(2000, 2, 29)]
    assert timeline.month_ends(dt.date(2000, 2, 1), dt.date(2000, 2, 28)) == []


# -- U6, U7 --------------------------------------------------------------------------------

def _sets(spark, n, seed, people=60, share=0.5):
    r = random.Random(seed)
    held = [{p for p in range(people) if r.random() < share} for _ in range(n)]
    frames = [(f"s{i}", spark.createDataFrame([(p,) for p in sorted(h)] or [(None,)], "id long"), "id") for i, h in enumerate(held)]
    return held, frames


def test_overlap_of_four_sets(spark):
    held, frames = _sets(spark, 4, 2)
    got = {tuple(x.sets): x["size"] for x in overlap.set_overlap(spark, frames).collect()}
    assert got == {c: len(set.intersection(*[held[i] for i in c])) for k in range(1, 5) for c in itertools.combinations(range(4), k)}


def test_overlap_of_forty_sets(spark):
    held, frames = _sets(spark, 40, 3, people=25, share=0.3)
    got = {tuple(x.sets): (x["size"], x.label) for x in overlap.set_overlap(spark, frames, zeros=False, most=2).collect()}
    want = {c: len(set.intersection(*[held[i] for i in c])) for k in (1, 2) for c in itertools.combinations(range(40), k)}
    assert {c: n for c, (n, _) in got.items()} == {c: n for c, n in want.items() if n}
    assert got[(39,)][1] == "s39"
    with pytest.raises(ValueError, match="zeros=False"):
        overlap.set_overlap(spark, frames)


# -- A9, U5 ----------------------------------------------------------------------------------

def test_sketches_within_their_bound(spark):
    n = 60_000
    s = spark.range(n).select(F.col("id").cast("string").alias(ID), F.lit("p").alias("PROVIDER_NAME"),
                              F.make_date(F.lit(2017), (F.col("id") % 3 + 1).cast("int"), F.lit(5)).alias("FROM_DATE"))
    months = sketches.people_sketches(s.unionByName(s.where("FROM_DATE = '2017-01-05'").withColumn("FROM_DATE", F.lit(dt.date(2017, 2, 7)))))
    e = {x.month.month: x for x in sketches.estimate(months).collect()}
    for month, exact in ((1, n // 3), (2, 2 * n // 3), (3, n // 3)):
        assert 0 < abs(e[month].n_people - exact) <= e[month].n_people_bound
    all_ = sketches.estimate(sketches.unite(months, ["PROVIDER_NAME"])).first()
    assert abs(all_.n_people - n) <= all_.n_people_bound < n / 10
    kept = {x.month.month: x for x in sketches.kept_from_month_to_month(months).collect()}
    assert abs(kept[2].n_kept - n // 3) < 0.1 * n and kept[1].n_kept == 0 and kept[3].n_kept < 0.02 * n
    few = sketches.estimate(sketches.people_sketches(s.limit(100))).collect()
    assert sum(x.n_people for x in few) == 100 and all(x.n_people_bound == 0 for x in few)


# -- M24 ----------------------------------------------------------------------------------------

def test_row_changes_count_repeated_rows(spark):
    schema = f"{ID} string, PROVIDER_NAME string, status string, due date"
    day = dt.date(2017, 1, 1)
    before = [("1", "p", "a", day), ("2", "p", "a", None), ("3", "p", "a", day), ("3", "p", "a", day), ("4", "p", "a", day), (None, None, "a", None), ("6", "p", "a", day)]
    after = [("1", "p", "a", day), ("2", "p", "b", None), ("3", "p", "a", day), ("4", "p", "a", None), ("5", "p", "c", day), ("5", "p", "d", day),
             (None, None, "a", None)]
    got = row_changes(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema))
    assert _rows(got) == [("2", "p", "status", 1, 1, "a", "b"), ("3", "p", "details", 2, 1, "a", "a"), ("4", "p", "details", 1, 1, "a", "a"),
                          ("5", "p", "added", 0, 2, "", "c,d"), ("6", "p", "closed", 1, 0, "a", "")]
    assert _rows(change_counts(got)) == [("added", 1, 0, 2), ("closed", 1, 1, 0), ("details", 2, 3, 2), ("status", 1, 1, 1)]
    same = spark.createDataFrame(before, schema)
    assert row_changes(same, same).count() == 0
    with pytest.raises(ValueError, match="columns differ"):
        row_changes(same, same.drop("due"))


# -- M19, M20 -------------------------------------------------------------------------------------

def test_dense_months_have_zeros(spark):
    m = spark.createDataFrame([("a", dt.date(2017, 1, 1), 3), ("a", dt.date(2017, 4, 1), 1), ("b", dt.date(2017, 4, 1), 2), (None, dt.date(2015, 4, 1), 9)],
                              "PROVIDER_NAME string, month_complete date, n long")
    d = reports.dense_months(m, days=100)
    got = {(x[0], x[1].month): x[2] for x in d.collect()}
    assert got == {(p, k): {("a", 1): 3, ("a", 4): 1, ("b", 4): 2}.get((p, k), 0) for p in ("a", "b", None) for k in (12, 1, 2, 3, 4)}
    t = reports.trailing_months_dense(m, days=100).collect()
    assert Counter(x.n for x in t) == Counter([0, 3, 0, 0, 3]) and {x.mean_per_month for x in t} == {1.2}
    assert reports.dense_months(m.where("false")).count() == 0


# -- S9 ---------------------------------------------------------------------------------------------

def test_a_run_needs_one_kind_of_input(spark):
    one = Source(("x",))
    inputs = Inputs(one, one, one, ((one, "k", "d", "serial"),), one)
    with pytest.raises(ValueError, match="either"):
        Run(spark)
    with pytest.raises(ValueError, match="either"):
        Run(spark, SF_SMALL, inputs=inputs)
    with pytest.raises(ValueError, match="configuration"):
        Run(spark, inputs=inputs)


# -- M9, M13 for one person of many rows --------------------------------------------------------------

def test_a_person_of_many_rows_is_many_tasks(spark):
    from rosterkit.config import RunConfig
    from rosterkit.operators.roster import people_of_many_rows, roster_rows
    from rosterkit.operators.worklist import worklist
    day = dt.date(2010, 1, 1)
    spine = spark.createDataFrame(
        [(f"p{k}", True, True, k % 2 == 0, dt.date(2016, 5, 1) if k % 2 == 0 else None, [("A", day, day), ("B", day, day)][:1 + k % 2]) for k in range(8)],
        f"{ID} string, in_svs boolean, in_qi boolean, has_sis boolean, sis_completed_dt date, "
        "providers array<struct<PROVIDER_NAME: string, initial_service: date, most_recent_service: date>>")
    # p0 has many of both, p1 many deferrals and no admission, p2 many admissions and no deferral, p3 few
    d = [(p, day + dt.timedelta(days=k), True, k % 2 == 0) for p, n in (("p0", 70), ("p1", 90), ("p3", 2)) for k in range(n)]
    a = [(p, day + dt.timedelta(days=k)) for p, n in (("p0", 50), ("p2", 80), ("p3", 3)) for k in range(n)]
    deferrals = spark.createDataFrame(d + d[:20] + [(None, day, True, True)], f"{ID} string, defer_date date, deferral boolean, deferral_active boolean")
    admissions = spark.createDataFrame(a + a[:20] + [(None, day)], "medicaid_id string, agency_admission_date date")
    cfg = RunConfig(as_of=dt.date(2019, 1, 1), due_floor=dt.date(2012, 1, 1))
    assert people_of_many_rows(deferrals, admissions, 100) is None
    many = people_of_many_rows(deferrals, admissions, 8)
    assert {x[ID]: (x._nd, x._na) for x in many.collect()} == {"p0": (9, 7), "p1": (12, 1), "p2": (1, 10)}
    plain, spread = (roster_rows(spine, deferrals, admissions, cfg, many=m) for m in (None, many))
    assert plain.columns == spread.columns and _rows(plain) == _rows(spread)
    assert plain.where(f"{ID} = 'p0'").count() == 70 * 50
    assert _rows(worklist(plain)) == _rows(worklist(spread, spread=True))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", False)
        tasks = [x.n for x in spread.where(f"{ID} = 'p0'").groupBy(F.spark_partition_id().alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(tasks) >= 6 and max(tasks) < 70 * 50 / 2


# -- scratch tables and folders ------------------------------------------------------------------------

def test_scratch_is_removed_with_its_scope(spark, tmp_path):
    import os

    from rosterkit.session import checkpoint_path, is_machine_local, scratch_scope
    with scratch_scope(spark):
        path = checkpoint_path(spark, "scope-test")
        spark.range(5).write.parquet(path)
        local = path.removeprefix("file:")
        assert os.path.isdir(local) and spark.read.parquet(path).count() == 5
    assert not os.path.exists(local)
    outside = checkpoint_path(spark, "scope-test-kept")
    spark.range(5).write.parquet(outside)
    assert spark.read.parquet(outside).count() == 5
    assert is_machine_local("file:/x") and is_machine_local("/x") and not is_machine_local("hdfs://n/x") and not is_machine_local("s3a://b/x")
