import datetime as dt

from pyspark.sql import functions as F

from rosterkit.config import RunConfig
from rosterkit.operators import cohorts, overlap, roster, schema, summary, worklist
from rosterkit.operators.cohorts import ID

D = dt.date
AS_OF = D(2018, 6, 30)
CFG = RunConfig(as_of=AS_OF, procedure_codes=("T1017",), payer_codes=("Y",), due_floor=None, fy_cutoff=D(2018, 6, 30))


def services(spark, rows):
    return spark.createDataFrame(rows, "MEDICAID_ID string, PROVIDER_NAME string, CPT_CD string, MEDICAID string, "
                                       "HMP_ELIG boolean, FROM_DATE date")


def frames(spark, svs, qi, sis, defer=(), adm=()):
    s = services(spark, svs)
    q = spark.createDataFrame(qi, "MEDICAID_ID string").select(ID, F.lit(True).alias("eligible_qi"))
    a = spark.createDataFrame(sis, "mcaid_id string, sis_completed_dt date")
    d = spark.createDataFrame(list(defer), "MEDICAID_ID string, defer_date date, deferral boolean, deferral_active boolean")
    m = spark.createDataFrame(list(adm), "medicaid_id string, agency_admission_date date")
    return s, q, a, d, m


def test_roster_edges(spark):
    svs = [("p1", "A", "T1017", "Y", False, D(2018, 1, 1)),   # eligible at A
           ("p1", "B", "T1017", "Y", False, D(2018, 2, 1)),   # and at B
           ("p2", "A", "X", "Y", False, D(2018, 1, 1)),       # ineligible service, assessed
           ("p4", "A", "T1017", "N", None, D(2018, 1, 1)),    # payer fails, HMP unknown: not eligible
           (None, "A", "T1017", "Y", False, D(2018, 1, 1))]   # NULL id never reaches the roster
    s, q, a, d, m = frames(spark, svs, [("p1",), ("p5",)],
                           [("p2", D(2016, 1, 1)), ("p3", D(2017, 1, 1)), ("p5", D(2017, 3, 1))])
    r = roster.build_roster(s, q, a, d, m, CFG)
    got = {(x[ID], x.PROVIDER_NAME): x for x in r.collect()}
    assert set(got) == {("p1", "A"), ("p1", "B"), ("p2", None), ("p5", None)}  # p3 (assessment only) dropped
    assert got[("p2", None)].sis_complete_inel and not got[("p2", None)].sis_eligible
    assert got[("p1", "A")].sis_eligible and not got[("p1", "A")].sis_complete_any
    assert r.columns[:8] == [ID, "PROVIDER_NAME", "sis_completed_dt", "due_by_dt", "defer_date",
                             "agency_admission_date", "initial_service", "most_recent_service"]
    assert r.count() == r.distinct().count()
    w = worklist.worklist(r).collect()
    # same top issue (initial needed) at two providers: two rows; p5 has no provider: excluded
    assert sorted((x[ID], x.PROVIDER_NAME, x.n_priority) for x in w) == [("p1", "A", 1), ("p1", "B", 1)]


def test_fy_roster_keeps_assessment_only_people(spark):
    svs = [("p1", "A", "T1017", "Y", False, D(2018, 1, 1)), ("p1", "A", "T1017", "Y", False, D(2018, 7, 1))]
    s, q, a, d, _ = frames(spark, svs, [("p1",)], [("p3", D(2015, 1, 1)), ("p1", D(2018, 8, 1))],
                           defer=[("p3", D(2018, 1, 1), True, True)])
    fy = {x[ID]: x for x in roster.build_fy_roster(s, q, a, d, CFG).collect()}
    assert fy["p3"].eligible_svs is None and fy["p3"].deferral is None and fy["p3"].sis_overdue
    assert fy["p1"].most_recent_service == D(2018, 1, 1)  # service after the cut-off ignored
    assert fy["p1"].sis_completed_dt is None               # assessment after the cut-off ignored


def test_due_and_flags_boundaries(spark):
    df = spark.createDataFrame([
        ("due today", D(2015, 6, 30), None, None, None),
        ("due in 90", D(2015, 9, 28), None, None, None),
        ("expired deferral", None, D(2017, 3, 1), False, None),
        ("admitted", None, None, None, D(2017, 5, 31)),
    ], "k string, sis_completed_dt date, defer_date date, deferral_active boolean, agency_admission_date date")
    out = {x.k: x for x in roster.compliance_flags(roster.due_date(df), AS_OF).collect()}
    assert out["due today"].due_by_dt == AS_OF and not out["due today"].sis_overdue and out["due today"].sis_coming90
    assert out["due in 90"].due_by_dt == D(2018, 9, 28) and out["due in 90"].sis_coming90 is False
    assert out["expired deferral"].due_by_dt == D(2018, 3, 1)
    assert out["admitted"].due_by_dt is None  # 05-31 + 9 months does not exist
    assert out["due today"].end_of_fy == D(2018, 9, 30)
    floored = roster.due_date(df, due_floor=D(2018, 1, 1)).collect()
    assert {x.k: x.due_by_dt for x in floored}["expired deferral"] == D(2018, 3, 1)
    assert {x.k: x.due_by_dt for x in floored}["admitted"] is None


def test_deferral_active_boundaries(spark):
    src = spark.createDataFrame([(" 12", D(2017, 6, 30)), ("13", D(2017, 6, 29)), ("14", None)],
                                "`Medicaid ID` string, `Referral Date` date")
    out = {x[ID]: x.deferral_active for x in cohorts.prep_deferrals([(src, "Medicaid ID", "Referral Date", "datetime")],
                                                                     AS_OF).collect()}
    assert out == {"0000000 12": True, "0000000013": False, "0000000014": False}


def test_latest_assessment_null_propagates(spark):
    a = spark.createDataFrame([("p", D(2017, 1, 1)), ("p", None), ("q", D(2016, 1, 1))], "mcaid_id string, sis_completed_dt date")
    got = {x.mcaid_id: x.sis_completed_dt for x in cohorts.latest_assessment(a).collect()}
    assert got == {"p": None, "q": D(2016, 1, 1)}


def test_keep_group_extreme_keeps_ties_and_null_key(spark):
    df = spark.createDataFrame([("c1", 1, "x"), ("c1", 3, "y"), ("c1", 3, "z"), (None, 2, "n"), (None, 1, "m"),
                                ("c2", None, "q")], "k string, v int, tag string")
    got = sorted(x.tag for x in cohorts.keep_group_extreme(df, ["k"], "v", "max").collect())
    assert got == ["n", "y", "z"]


def test_set_overlap_fixture(spark):
    ids = spark.createDataFrame([("1", "A"), ("2", "A"), ("2", "B"), ("3", "B"), ("4", "C")], "id string, s string")
    sets = [(n, ids.where(F.col("s") == n), "id") for n in ("A", "B", "C")]
    got = {tuple(x.sets): x.size for x in overlap.set_overlap(spark, sets).collect()}
    assert got == {(0,): 2, (1,): 2, (0, 1): 1, (2,): 1, (0, 2): 0, (1, 2): 0, (0, 1, 2): 0}


def test_summary_total_is_sum_and_null_group_kept(spark):
    df = spark.createDataFrame([("A", True, True, False), ("A", True, False, None), (None, True, True, True)],
                               "PROVIDER_NAME string, sis_eligible boolean, sis_complete boolean, sis_overdue boolean")
    df = df.withColumn("deferral", F.lit(False))
    rows = {(x.PROVIDER_NAME, x.is_total): x for x in summary.fy_summary(df, "Total").collect()}
    assert rows[("A", 0)].denominator == 2 and rows[("A", 0)].overdue == 0
    assert rows[(None, 0)].numerator == 0
    assert rows[("Total", 1)].denominator == 3 and rows[("Total", 1)].completed == 2
    assert rows[("Total", 1)].percent_complete == 33.3


def test_schema_helpers(spark):
    assert schema.clean_name("DISABILITY/DD", "strip") == "DISABILITYDD"
    assert schema.clean_name("MEDICAID RECIP-ID", "strip") == "MEDICAID_RECIPID"
    assert schema.clean_name("CLM ID: A-B", "underscore") == "CLM_ID_A_B"
    assert schema.clean_name("Case Number:", "lower") == "case_number_"
    df = spark.createDataFrame([("1", None, "2-X"), ("2", None, "9-Y")], "a string, b string, PROVIDER_NAME string")
    assert schema.drop_all_null(df).columns == ["a", "PROVIDER_NAME"]
    rec = df.select(schema.recode("PROVIDER_NAME", {"2-X": "X"}).alias("p")).collect()
    assert [x.p for x in rec] == ["X", "9-Y"]
    ordered = schema.reorder(spark.createDataFrame([(1, 2, 3, 4, 5)], "z int, a_dt int, eligible_x int, b_date int, MEDICAID_ID int"),
                             named=["MEDICAID_ID"], suffixes=["_dt", "_date"], prefixes=["eligible"])
    assert ordered.columns == ["MEDICAID_ID", "a_dt", "b_date", "eligible_x", "z"]
    counts = spark.createDataFrame([("r1", "a", 2), ("r2", "b", 5)], "row string, col string, n long")
    wide = {x.row: x for x in schema.pivot_counts(counts, "row", "col", "n", ["a", "b"]).collect()}
    assert wide["r1"].b == 0 and wide["r2"].b == 5


def test_attribute_eligibility_blank_flag(spark):
    attrs = spark.createDataFrame([("a", "1", None, None, None, D(1990, 1, 1)), ("b", None, "1", None, None, D(1990, 1, 1)),
                                   ("c", "2", "1", None, None, D(1990, 1, 1)), ("d", "1", None, None, None, D(2010, 1, 1)),
                                   ("e", "3", None, "1", None, D(1990, 1, 1))],
                                  "MEDICAID_ID string, DISABILITYDD string, MOBILITY string, PERSONAL string, "
                                  "SUPPORT_SYSTEM string, DATE_OF_BIRTH date")
    code = {x[ID] for x in cohorts.eligible_by_attributes(attrs, AS_OF).collect()}
    comment = {x[ID] for x in cohorts.eligible_by_attributes(attrs, AS_OF, blank_uses_proxies=True).collect()}
    assert code == {"a", "e"} and comment == {"a", "b", "e"}


def test_display_names_and_report_tables(spark):
    from rosterkit.operators import reports
    s = spark.createDataFrame([("A", 1200, 10, 5, 1500, 100, 7, 0, 2, 300, 0.4, 50.0, 0)],
                              "cmhsp string, denominator long, denominator_fy long, numerator long, eligible long, "
                              "due_in_fy long, completed_elig long, completed_inel long, overdue long, deferred long, "
                              "percent_complete double, percent_complete_fy double, is_total int")
    shown = summary.display_names(s)
    assert shown.columns[0] == "CMHSP" and shown.columns[-1].endswith("due in FY") and len(shown.columns) == 12
    d = reports.director_table(s).first()
    assert (d.organization, d.denominator, d.eligible, d.due_this_fy) == ("A", "1,200", "1,500", "100")
    assert reports.supervisor_table(s).columns[-3:] == ["completed", "overdue", "deferred"]


def test_open_admissions_compare_modes_and_drop_matching(spark):
    raw = spark.createDataFrame([("1", "0000000001", "2017-10-02", "10/2/2017", "junk"),
                                 ("1", "0000000001", "2017-9-30", "9/30/2017", "junk")],
                                "`case number` string, `medicaid id` string, `service start date` string, "
                                "`agency admission date` string, X_1 string")
    by_date = cohorts.open_admissions(raw).collect()
    by_text = cohorts.open_admissions(raw, compare_as="string").collect()
    assert [x.agency_admission_date for x in by_date] == [D(2017, 10, 2)]
    assert [x.agency_admission_date for x in by_text] == [D(2017, 9, 30)]  # '2017-9-30' > '2017-10-02' as text
    df = spark.createDataFrame([(1, 2, 3)], "a_notes int, X_b int, keep int")
    assert schema.drop_matching(df, suffix="NOTES").columns == ["X_b", "keep"]
    assert schema.drop_matching(df, prefix="x_").columns == ["a_notes", "keep"]


def test_null_tokens(spark):
    df = spark.createDataFrame([("Choose one", " ", 1), ("ok", "Enterprise Wide", 2)], "a string, b string, n int")
    out = schema.null_tokens(df, ("", " ", "NA", "Choose one", "Enterprise Wide")).collect()
    assert [(x.a, x.b, x.n) for x in out] == [(None, None, 1), ("ok", None, 2)]


def test_crosstab_with_dots_collisions_and_unlisted_providers(spark):
    from rosterkit.config import PROVIDER_RECODE
    from rosterkit.operators.reports import priority_crosstab
    names = [*PROVIDER_RECODE.values(), "A-B", "A B"]
    rows = [("p1", n) for n in names] + [("p1", "P9"), ("p2", "P9"), ("p2", None), ("p2", "A B")]
    w = spark.createDataFrame(rows, "priority string, PROVIDER_NAME string")
    got = {r.priority: r.asDict() for r in priority_crosstab(w, names).collect()}
    assert got["p1"]["n_st_clair_county_cmh"] == 1 and got["p1"]["n_a_b"] == 1 and got["p1"]["n_a_b_2"] == 1
    assert got["p1"]["n_other"] == 1 and got["p1"]["region_total"] == 7
    assert got["p2"] == {**{k: 0 for k in got["p2"]}, "priority": "p2", "n_a_b_2": 1, "n_other": 2, "region_total": 3}
    found = {r.priority: r.region_total for r in priority_crosstab(w).collect()}
    assert found == {"p1": 7, "p2": 3}


def test_pivot_of_values_with_dots(spark):
    counts = spark.createDataFrame([("r", "St. X", 2), ("s", "Y", 1)], "row string, col string, n int")
    from rosterkit.operators.schema import pivot_counts
    got = {r["row"]: (r["St. X"], r["Y"]) for r in pivot_counts(counts, "row", "col", "n", ["St. X", "Y"]).collect()}
    assert got == {"r": (2, 0), "s": (0, 1)}


def test_reconcile_sees_a_broken_worklist(spark):
    from rosterkit.operators.checks import flagged_not_in_worklist, reconcile
    from rosterkit.plans.flows import Run
    run = Run(spark, "/root/testdata/sf0.001")
    roster = run.cut_roster()
    work = run.worklist.checkpoint()
    good = reconcile(roster, work).first()
    assert good.n_people_missing == 0 and good.n_worklist_ids == good.n_worklist_ids_in_roster > 1
    one = work.select("MEDICAID_ID").first()[0]
    cut = reconcile(roster, work.where(work.MEDICAID_ID != one)).first()
    assert cut.n_worklist_ids == good.n_worklist_ids - 1
    alien = work.limit(1).withColumn("MEDICAID_ID", work.MEDICAID_ID * 0 - 7)
    bad = reconcile(roster, work.unionByName(alien.withColumn("MEDICAID_ID", alien.MEDICAID_ID.cast("string")))).first()
    assert bad.n_worklist_ids == good.n_worklist_ids + 1 and bad.n_worklist_ids_in_roster == good.n_worklist_ids_in_roster
    flagged = roster.where("sis_overdue or sis_coming90 or due_in_fy").select("MEDICAID_ID").first()[0]
    gone = work.where(work.MEDICAID_ID != flagged)
    assert reconcile(roster, gone).first().n_people_missing == 1
    assert {r.MEDICAID_ID for r in flagged_not_in_worklist(roster, gone).collect()} == {flagged}
