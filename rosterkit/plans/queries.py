"""Registered queries: one per inventory item, each ``(spark, sf_dir) -> DataFrame``.

Every query reads whole driver tables through the stand-in adapters; no
query samples, caps or filters rows by key.  Computed columns carry the
same names as the SQL oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as rf
from ..operators import checks, cohorts, schema
from ..operators.cohorts import ID
from .flows import Run

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(f):
        REGISTRY[name] = f
        return f
    return deco


def _run(spark, sf_dir) -> Run:
    return Run(spark, sf_dir)


# ---------------------------------------------------------------------------
# Composed marts
# ---------------------------------------------------------------------------

@query("services_clean")  # M1
def q_services_clean(spark, d):
    return _run(spark, d).services.select(
        F.col("CLM_ID").alias("clm_id"), ID, "PROVIDER_NAME", "CPT_CD", "MEDICAID", "FROM_DATE", "THRU_DATE",
        "HAB_WAIVER", "HMP_ELIG", "HMP_BUCKET")


ROWS_PER_FILE = 50_000
PREAMBLE = ["Services report", "Source: claims", "", "Parameters:", "  all providers", "", "Generated"]


def _staged(df, name: str):
    """The rows as a scratch table: an extract is built once, not for its count, its files' heads and its lines anew."""
    import uuid

    from ..session import checkpoint_path
    path = checkpoint_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _extract_files(df, name: str, preamble, key_col: str) -> str:
    """Write an extract as preamble CSV files of about ROWS_PER_FILE rows; returns the glob.  Reads ``df`` three times."""
    import uuid

    from ..session import checkpoint_path
    from ..sources import files
    n = max(2, -(-df.count() // ROWS_PER_FILE))
    key = F.pmod(F.xxhash64(F.col(f"`{key_col}`")), F.lit(n))
    return files.write_with_preamble(df, checkpoint_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}"), preamble, key)


@query("services_via_files")  # S2, S4 + M1 on files written from the tables
def q_services_via_files(spark, d):
    """Round trip: the claim extract is written as preamble CSV files (closed years and current
    period in two folders) into the shared checkpoint folder, then read back with the
    preamble-skipping reader and cleaned."""
    from ..sources import files
    r = _run(spark, d)
    raw = _staged(r.raw_services.drop("NOTE:"), "services")
    closed = F.coalesce(F.substring(F.col("`THRU DATE`"), 1, 4) < F.lit(str(r.cfg.as_of.year)), F.lit(False))
    paths = [_extract_files(raw.where(closed), "services-closed", PREAMBLE, "CLM ID"),
             _extract_files(raw.where(~closed), "services-current", PREAMBLE, "CLM ID")]
    back = files.read_many(spark, paths, skip=len(PREAMBLE), keep_source=False)
    return cohorts.prep_services(back, r.cfg.provider_recode).select(
        F.col("CLM_ID").alias("clm_id"), ID, "PROVIDER_NAME", "CPT_CD", "MEDICAID", "FROM_DATE", "THRU_DATE",
        "HAB_WAIVER", "HMP_ELIG", "HMP_BUCKET")


@query("admissions_via_files")  # S3 + M8: skip 3, whole-row duplicates across files dropped
def q_admissions_via_files(spark, d):
    from ..sources import files
    from ..sources.standin import raw_admissions
    raw = raw_admissions(spark, d).drop("X_1")
    path = _extract_files(raw, "admissions", ["Admissions", "", "Generated"], "case number")
    back = files.read_many(spark, [path], skip=3, dedupe=True, keep_source=False)
    return cohorts.open_admissions(back.withColumn("X_1", F.lit(None).cast("string")))


@query("assessments_via_files")  # S7 + S5: a description row after each header
def q_assessments_via_files(spark, d):
    from ..config import ASSESSMENT_NULL_TOKENS
    from ..sources import files
    raw = _run(spark, d).raw_assessments.select("Assessment ID", "statusText", "sis_region")
    # the header goes in as the last preamble line; the writer's own header is the description row
    path = _extract_files(raw, "assessments", ["Assessments", "Assessment ID,statusText,sis_region"], "Assessment ID")
    back = files.read_many(spark, [path], skip=1, drop_rows_after_header=1, keep_source=False)
    back = schema.null_tokens(back, ASSESSMENT_NULL_TOKENS)
    return back.select(F.col("`Assessment ID`").alias("sis_id"), "statusText", "sis_region")


@query("load_audit")  # S8: rows per source file
def q_load_audit(spark, d):
    import uuid

    from ..session import checkpoint_path
    from ..sources import files
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    path = files.write_with_preamble(c, checkpoint_path(spark, f"customers-{uuid.uuid4().hex}"), [], F.col("c_custkey") % 4)
    per_file = files.load_audit(files.read_many(spark, [path]))
    return per_file.select(F.regexp_extract(files.SOURCE_FILE, "_file=([0-9]+)/", 1).cast("int").alias("file"), "rows")


@query("quoted_records_via_files")  # S2, S3: line breaks in quoted fields
def q_quoted_records_via_files(spark, d):
    from ..sources import files
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "text")
    path = _extract_files(docs, "documents", ["A report", "It's with line breaks"], "doc_id")
    back = files.read_many(spark, [path], skip=2, multiline=True, keep_source=False)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text",
                       (F.size(F.split("text", "\n")) - 1).alias("n_breaks"))


@query("inferred_types")  # S1, S3: the least type that every file's values have
def q_inferred_types(spark, d):
    from ..sources import files, types
    o = spark.read.parquet(f"{d}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    raw = o.select(
        F.col("o_orderkey").cast("string").alias("order"), F.when(F.col("o_orderstatus") == "O", "TRUE").otherwise("FALSE").alias("open"),
        F.col("o_totalprice").cast("string").alias("price"), day.cast("string").alias("ordered"), F.col("o_orderpriority").alias("priority"),
        F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("code"), F.lit(None).cast("string").alias("nothing"),
        F.date_format(day, "M/d/yyyy").alias("month"))
    path = _extract_files(raw, "typed", ["Orders"], "order")
    return types.inferred_columns(files.read_many(spark, [path], skip=1, keep_source=False), raw.columns)


@query("incremental_services")  # S4, S8: closed years first, then both folders; only new files are read
def q_incremental_services(spark, d):
    import uuid

    from ..session import checkpoint_path
    from ..sources import files, incremental
    r = _run(spark, d)
    raw = _staged(r.raw_services.drop("NOTE:"), "services")
    closed = F.coalesce(F.substring(F.col("`THRU DATE`"), 1, 4) < F.lit(str(r.cfg.as_of.year)), F.lit(False))
    paths = [_extract_files(raw.where(closed), "services-closed", PREAMBLE, "CLM ID"),
             _extract_files(raw.where(~closed), "services-current", PREAMBLE, "CLM ID")]
    store = checkpoint_path(spark, f"services-store-{uuid.uuid4().hex}")
    incremental.load_new(spark, paths[:1], store, skip=len(PREAMBLE))
    incremental.load_new(spark, paths, store, skip=len(PREAMBLE))
    s = cohorts.prep_services(incremental.loaded(spark, store), r.cfg.provider_recode)
    return s.groupBy("PROVIDER_NAME").agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct(ID).alias("n_people"),
                                          F.min("FROM_DATE").alias("first_service"), F.max("FROM_DATE").alias("last_service"))


@query("select_prefixed")  # C10: the person, the provider and all columns of one prefix
def q_select_prefixed(spark, d):
    r = _run(spark, d).roster
    return r.select(ID, "PROVIDER_NAME", *schema.select_prefixed(r, "sis_"))


@query("encode_levels")  # C12: codes in the order of the values, from a dictionary table
def q_encode_levels(spark, d):
    from ..operators import levels
    s = _run(spark, d).services.select(F.col("CLM_ID").alias("clm_id"), "PROVIDER_NAME", "CPT_CD", F.col("FROM_DATE").cast("string").alias("FROM_DATE"))
    return levels.encode_levels(s, ["PROVIDER_NAME", "CPT_CD", "FROM_DATE"])[0]


@query("drop_levels")  # C17: the people that still occur among eligible services, with new codes
def q_drop_levels(spark, d):
    from ..operators import levels
    r = _run(spark, d)
    people = levels.levels_of(r.services, [ID])
    coded, _ = levels.encode_levels(r.elig_svs.select(ID), [ID], people)
    return levels.drop_levels(people, coded, {ID: ID + "_code"})


@query("summary_timeline")  # M16, M18 at every month end: claims read once
def q_summary_timeline(spark, d):
    import datetime as dt

    from ..operators import timeline
    r = _run(spark, d)
    return r.summary_timeline(timeline.month_ends(dt.date(1992, 1, 31), r.cfg.as_of))


@query("set_overlap_many")  # U6, U7: singles and pairs of 40 sets
def q_set_overlap_many(spark, d):
    from ..operators.overlap import set_overlap
    s = _run(spark, d).services.select(ID, F.dayofmonth("FROM_DATE").alias("day"), "PROVIDER_NAME", "CPT_CD")
    labels = _run(spark, d).providers
    bit = lambda n: F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")), F.lit(0).cast("long"))
    number = F.when(F.col("PROVIDER_NAME").isin(labels), F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("PROVIDER_NAME")) + 30)
    code = F.when(F.col("CPT_CD") < "5", F.left("CPT_CD", F.lit(1)).cast("int") + 35)
    # a claim's sets as bits, in place of 40 filters over the claims; few claims differ in provider and code once they are grouped
    member = s.groupBy(ID, "PROVIDER_NAME", "CPT_CD").agg(F.bit_or(bit(F.col("day") - 1)).alias("days"))
    member = member.select(ID, F.col("days").bitwiseOR(bit(number)).bitwiseOR(bit(code)).alias("mask"))
    out = set_overlap(spark, [str(k) for k in range(40)], zeros=False, most=2, members=(member, ID, "mask"))
    return out.select(F.array_join("sets", ",").alias("sets_key"), "size")


def _within(n, bound):
    """The estimate is exact while its bound is 0: it then is the count itself, which the SQL compares."""
    return (F.col(bound) >= 0).alias("within")


@query("people_sketches")  # A9: theta sketches per provider and month
def q_people_sketches(spark, d):
    from ..operators import sketches
    e = sketches.estimate(sketches.people_sketches(_run(spark, d).services))
    return e.select("PROVIDER_NAME", "month", "n_people", _within("n_people", "n_people_bound"))


@query("sketch_unions")  # A9: the months' sketches united per provider
def q_sketch_unions(spark, d):
    from ..operators import sketches
    e = sketches.estimate(sketches.unite(sketches.people_sketches(_run(spark, d).services, 16), ["PROVIDER_NAME"], 16), lg_nominal=16)
    return e.select("PROVIDER_NAME", "n_people", _within("n_people", "n_people_bound"))


@query("kept_people")  # U4, U5 on sketches: people also served the month before
def q_kept_people(spark, d):
    from ..operators import sketches
    k = sketches.kept_from_month_to_month(sketches.people_sketches(_run(spark, d).services))
    return k.select("PROVIDER_NAME", "month", "n_people", "n_kept", "n_new", _within("n_people", "n_people_bound"))


@query("trailing_months_dense")  # M19, M20 with empty months
def q_trailing_months_dense(spark, d):
    from ..operators.reports import trailing_months_dense
    return trailing_months_dense(_run(spark, d).monthly)


@query("dense_months")  # M19: every provider and month of the window
def q_dense_months(spark, d):
    from ..operators.reports import dense_months
    return dense_months(_run(spark, d).monthly)


@query("service_eligibility")  # M2
def q_service_eligibility(spark, d):
    return _run(spark, d).elig_svs


@query("attributes_clean")  # M3
def q_attributes_clean(spark, d):
    return _run(spark, d).attributes.select(ID, "DISABILITYDD", "MOBILITY", "PERSONAL", "SUPPORT_SYSTEM",
                                            "DATE_OF_BIRTH")


@query("attribute_eligibility")  # M4
def q_attribute_eligibility(spark, d):
    return _run(spark, d).elig_qi


@query("assessments_clean")  # M5
def q_assessments_clean(spark, d):
    return _run(spark, d).assessments.select(
        "sis_id", "mcaid_id", "sis_completed_dt", "start", "end", "duration", "DaysSince", "age",
        "sis_wk", "sis_yr", "sis_yrwk", "isp_begin_date", "statusChangeDate")


@query("latest_assessment")  # M6
def q_latest_assessment(spark, d):
    return _run(spark, d).latest


@query("deferral_status")  # M7
def q_deferral_status(spark, d):
    return _run(spark, d).deferrals


@query("open_admissions")  # M8
def q_open_admissions(spark, d):
    return _run(spark, d).admissions


@query("roster")  # M9
def q_roster(spark, d):
    return _run(spark, d).roster


@query("roster_spread")  # M9 with every person of over 16 deferrals or admissions split over tasks
def q_roster_spread(spark, d):
    return _spread_run(spark, d).roster


@query("worklist_spread")  # M13 on that roster
def q_worklist_spread(spark, d):
    return _spread_run(spark, d).worklist


def _spread_run(spark, d) -> Run:
    from dataclasses import replace
    return Run(spark, d, replace(_run(spark, d).cfg, fan_out_limit=16))


@query("due_dates")  # M10
def q_due_dates(spark, d):
    return _run(spark, d).roster.select(ID, "PROVIDER_NAME", "sis_completed_dt", "defer_date", "deferral_active",
                                        "agency_admission_date", "due_by_dt")


@query("compliance_flags")  # M11
def q_compliance_flags(spark, d):
    return _run(spark, d).roster.select(ID, "PROVIDER_NAME", "due_by_dt", "end_of_fy", "sis_overdue",
                                        "sis_coming90", "due_in_fy")


@query("eligibility_flags")  # M12
def q_eligibility_flags(spark, d):
    return _run(spark, d).roster.select(ID, "PROVIDER_NAME", "eligible_svs", "eligible_qi", "sis_eligible",
                                        "sis_complete_elig", "sis_complete_inel", "sis_complete_any")


@query("worklist")  # M13
def q_worklist(spark, d):
    return _run(spark, d).worklist


@query("worklist_split_files")  # K2 + M13: one ordered CSV folder per provider, read back
def q_worklist_split_files(spark, d):
    import uuid

    from ..session import checkpoint_path
    from ..sources.sinks import write_split
    w = _run(spark, d).worklist
    base = write_split(w, "PROVIDER_NAME", checkpoint_path(spark, f"worklist-split-{uuid.uuid4().hex}"),
                       "most_recent_service")
    return spark.read.option("header", True).schema(w.schema).csv(f"{base}/*/*.csv")


@query("summary_dated_csv")  # K1 + M14: date-stamped CSV, read back
def q_summary_dated_csv(spark, d):
    import uuid

    from ..session import checkpoint_path
    from ..sources.sinks import write_csv
    r = _run(spark, d)
    path = write_csv(r.summary, checkpoint_path(spark, f"summary-{uuid.uuid4().hex}"), r.cfg.as_of)
    return spark.read.option("header", True).schema(r.summary.schema).csv(path)


@query("summary_display")  # C6 + O2: report headers, providers in order, total last (order as a column)
def q_summary_display(spark, d):
    from pyspark.sql.window import Window

    from ..operators.summary import display_names
    s = _run(spark, d).summary
    # one row per provider
    row = F.row_number().over(Window.orderBy("is_total", F.col("cmhsp").asc_nulls_first()))
    return display_names(s.withColumn("row", row.cast("long")), cols=[c for c in s.columns if c != "is_total"] + ["row"])


@query("completion_summary")  # M14
def q_completion_summary(spark, d):
    return _run(spark, d).summary


@query("monthly_completions")  # M15
def q_monthly_completions(spark, d):
    return _run(spark, d).monthly


@query("fy_roster")  # M16
def q_fy_roster(spark, d):
    return _run(spark, d).fy_roster


@query("fy_worklist")  # M17
def q_fy_worklist(spark, d):
    return _run(spark, d).fy_worklist


@query("fy_summary")  # M18
def q_fy_summary(spark, d):
    return _run(spark, d).fy_summary


@query("fy_summary_uncut")  # Q9: with the assessments after the cut-off, as the original joins them
def q_fy_summary_uncut(spark, d):
    from dataclasses import replace
    return Run(spark, d, replace(_run(spark, d).cfg, fy_uncut_assessments=True)).fy_summary


@query("summary_from_paths")  # S9: a run built from file paths alone
def q_summary_from_paths(spark, d):
    from ..config import Inputs, Source
    r = _run(spark, d)
    put = lambda df, name, key, preamble=(): Source((_extract_files(_staged(df, name), name, list(preamble), key),), skip=len(preamble))
    deferrals = []
    for i, (df, key, date, kind) in enumerate(r.deferral_sources):
        text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
        deferrals.append((put(text, f"deferrals{i}", key), key, date, kind))
    inputs = Inputs(
        services=put(r.raw_services.drop("NOTE:"), "services", "CLM ID", PREAMBLE),
        attributes=put(r.raw_attributes, "attributes", "MEDICAID RECIP ID"),
        assessments=put(r.raw_assessments, "assessments", "Assessment ID", ["Assessments"]),
        deferrals=tuple(deferrals), admissions=put(r.raw_admissions, "admissions", "case number", ["Admissions", "", "Generated"]))
    return Run(spark, cfg=r.cfg, inputs=inputs).summary


@query("fy_worklist_numbered")  # M17 + K3 (row names), O1 order
def q_fy_worklist_numbered(spark, d):
    from ..sources.sinks import with_row_number
    w = _run(spark, d).fy_worklist
    order = [F.col("most_recent_service").desc_nulls_last(), F.col(ID).asc_nulls_last(),
             F.col("PROVIDER_NAME").asc_nulls_last(), F.col("initial_service").asc_nulls_last(),
             F.col("status").asc_nulls_last()]
    return with_row_number(w, order, "row")


@query("trailing_months")  # M19
def q_trailing_months(spark, d):
    return _run(spark, d).trailing_months()


@query("narrative_metrics")  # M20
def q_narrative_metrics(spark, d):
    return _run(spark, d).narrative()


@query("priority_crosstab")  # M21
def q_priority_crosstab(spark, d):
    return _run(spark, d).crosstab()


@query("director_table")  # M22
def q_director_table(spark, d):
    from ..operators.reports import director_table
    return director_table(_run(spark, d).summary)


@query("supervisor_table")  # M23
def q_supervisor_table(spark, d):
    from ..operators.reports import supervisor_table
    return supervisor_table(_run(spark, d).summary)


@query("reconcile_missing")  # M24 rows
def q_reconcile_missing(spark, d):
    return _run(spark, d).reconcile_rows()


@query("reconcile_counts")  # M24 counts
def q_reconcile_counts(spark, d):
    return _run(spark, d).reconcile_counts()


@query("worklist_changes")  # M24: the worklists of two run dates over the same extracts
def q_worklist_changes(spark, d):
    import datetime as dt
    from dataclasses import replace

    from ..operators.changes import row_changes
    now = _run(spark, d)
    before = Run(spark, d, replace(now.cfg, as_of=dt.date(1999, 3, 31)))
    return row_changes(before.worklist, now.worklist)


@query("coverage_gap")  # M25
def q_coverage_gap(spark, d):
    return _run(spark, d).coverage_gap()


@query("set_overlap")  # M26
def q_set_overlap(spark, d):
    return _run(spark, d).overlap().select("mask", F.array_join("sets", ",").alias("sets_key"), "label", "size")


# ---------------------------------------------------------------------------
# Single operators on whole tables
# ---------------------------------------------------------------------------

@query("normalize_id")  # T1
def q_normalize_id(spark, d):
    raw = _run(spark, d).raw_services
    return raw.select(F.col("`CLM ID`").alias("clm_id"), rf.normalize_id("MEDICAID ID").alias(ID))


@query("pad_then_clean_id")  # T2 (+ U2, D4, D5)
def q_pad_then_clean_id(spark, d):
    u = cohorts.union_sources(_run(spark, d).deferral_sources)
    return u.select(rf.pad_then_normalize(ID).alias(ID), "defer_date")


@query("union_sources")  # U2 / S6
def q_union_sources(spark, d):
    return cohorts.union_sources(_run(spark, d).deferral_sources).withColumnRenamed(ID, "raw_id")


@query("mixed_dates")  # D1-D3
def q_mixed_dates(spark, d):
    raw = _run(spark, d).raw_services
    return raw.select(F.col("`CLM ID`").alias("clm_id"), rf.parse_mixed_date("FROM DATE").alias("from_date"),
                      rf.parse_ymd("THRU DATE").alias("thru_date"))


@query("excel_dates")  # D4, T4
def q_excel_dates(spark, d):
    raw = _run(spark, d).raw_assessments
    return raw.select(F.col("`Assessment ID`").alias("sis_id"),
                      rf.excel_serial_to_date(rf.cut_at_space("sis_completed_dt")).alias("sis_completed_dt"))


@query("time_of_day")  # D6, T5, D7
def q_time_of_day(spark, d):
    a = _run(spark, d).assessments
    return a.select("sis_id", "start", "end", "sis_cl_dob_dt", "dateUpdated")


@query("minutes_between")  # D8
def q_minutes_between(spark, d):
    return _run(spark, d).assessments.select("sis_id", "duration")


@query("age_bands")  # D9, D10, D12
def q_age_bands(spark, d):
    r = _run(spark, d)
    a = r.attributes
    age = rf.age_on("DATE_OF_BIRTH", r.cfg.as_of, r.cfg.days_per_year)
    return a.select(ID, "DATE_OF_BIRTH", age.alias("age"), (age >= 18).alias("adult"),
                    rf.days_since("DATE_OF_BIRTH", r.cfg.as_of).alias("days_old"),
                    rf.age_in_years_floor(F.lit(r.cfg.as_of), "DATE_OF_BIRTH").alias("age_floor"))


@query("calendar_add")  # D15, D16
def q_calendar_add(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", day.alias("d"), rf.add_calendar_months(day, 9).alias("plus_9m"),
                    rf.add_years(day, 1).alias("plus_1y"), rf.add_years(day, 3).alias("plus_3y"),
                    rf.add_calendar_months(day, 9, invalid="clamp").alias("plus_9m_clamp"),
                    F.date_add(day, 365 * 3).alias("plus_1095d"))


@query("fiscal_year_end")  # D17
def q_fiscal_year_end(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", rf.fiscal_year_end(day).alias("fy_end"),
                    rf.fiscal_year_end(day, rollover_month=11).alias("fy_end_nov"))


@query("week_month_floor")  # D11, D13, D14
def q_week_month_floor(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    day = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", rf.week_of_year(day).alias("week"), F.year(day).alias("year"),
                    rf.floor_week_sunday(day).alias("week_start"), rf.floor_month(day).alias("month_start"))


@query("null_tokens")  # S5
def q_null_tokens(spark, d):
    from ..config import ASSESSMENT_NULL_TOKENS
    raw = schema.null_tokens(_run(spark, d).raw_assessments, ASSESSMENT_NULL_TOKENS)
    return raw.select(F.col("`Assessment ID`").alias("sis_id"), "statusText", "sis_region")


@query("recode")  # C16
def q_recode(spark, d):
    r = _run(spark, d)
    return r.raw_services.select(F.col("`CLM ID`").alias("clm_id"),
                                 schema.recode("PROVIDER NAME", r.cfg.provider_recode).alias("PROVIDER_NAME"))


@query("yes_no_flags")  # L6, C11
def q_yes_no_flags(spark, d):
    return _run(spark, d).services.select(F.col("CLM_ID").alias("clm_id"), "HAB_WAIVER", "HMP_ELIG", "HMP_BUCKET")


@query("drop_all_null")  # C4, C2
def q_drop_all_null(spark, d):
    return schema.clean_names(schema.drop_all_null(_run(spark, d).raw_services), "underscore")


@query("unpivot_flags")  # R1
def q_unpivot_flags(spark, d):
    from ..operators.worklist import WORKLIST_COLUMNS
    r = _run(spark, d).roster.where(F.col("PROVIDER_NAME").isNotNull())
    return schema.unpivot_flags(r, WORKLIST_COLUMNS, ["sis_complete_any", "sis_complete_inel", "sis_overdue",
                                                      "sis_coming90", "due_in_fy", "deferral_active"])


@query("pivot_counts")  # R2, A11
def q_pivot_counts(spark, d):
    """Worklist rows per provider (rows) and priority rank (columns, the fixed 1..5), plus a row total.

    The column values are known, so no extra pass discovers them.
    """
    w = _run(spark, d).worklist
    counts = w.groupBy("PROVIDER_NAME", "n_priority").agg(F.count(F.lit(1)).alias("n"))
    wide = schema.pivot_counts(counts, "PROVIDER_NAME", "n_priority", "n", [1, 2, 3, 4, 5])
    out = wide.select("PROVIDER_NAME", *[F.col(f"`{k}`").alias(f"n_rank_{k}") for k in range(1, 6)])
    return out.withColumn("n_all", schema.row_sum([f"n_rank_{k}" for k in range(1, 6)]))


@query("rollup_total")  # A4, U3
def q_rollup_total(spark, d):
    from ..operators.summary import with_total
    r = _run(spark, d)
    codes = list(r.cfg.procedure_codes)
    return with_total(r.services, "PROVIDER_NAME", {"n_claims": F.count(F.lit(1)),
                                                    "n_eligible_claims": rf.count_true(F.col("CPT_CD").isin(codes))})


@query("distinct_with_null")  # A9
def q_distinct_with_null(spark, d):
    s = _run(spark, d).services
    return s.groupBy("PROVIDER_NAME").agg(rf.count_distinct_with_null(ID).alias("n_people"))


@query("null_counts")  # A10
def q_null_counts(spark, d):
    s = _run(spark, d).services
    return s.groupBy("PROVIDER_NAME").agg(rf.count_null(ID).alias("n_null_id"), F.count(F.lit(1)).alias("n_rows"))


@query("any_flag")  # P10
def q_any_flag(spark, d):
    r = _run(spark, d).roster
    return r.where(rf.any_true("sis_overdue", "sis_coming90", "due_in_fy")).select(
        ID, "PROVIDER_NAME", "due_by_dt", "sis_overdue", "sis_coming90", "due_in_fy")


@query("id_subtract")  # U4
def q_id_subtract(spark, d):
    r = _run(spark, d)
    return checks.ids_without_admission(r.services, r.admissions)


@query("id_intersect")  # U5
def q_id_intersect(spark, d):
    r = _run(spark, d)
    roster = r.cut_roster()
    return r.worklist.select(ID).distinct().intersect(roster.select(ID).distinct())


@query("anti_join")  # J6
def q_anti_join(spark, d):
    r = _run(spark, d)
    return r.elig_svs.join(r.elig_qi.select(ID), ID, "left_anti").select(ID, "PROVIDER_NAME")


@query("semi_join")  # J7
def q_semi_join(spark, d):
    r = _run(spark, d)
    # both id lists are cut: the anti join stays off the claims, and the claims meet plain ids, not another branch's id cleaning
    ids = r.worklist.select(ID).distinct().checkpoint(eager=True)
    gap = checks.ids_without_admission(ids, r.admissions).where(F.col(ID).isNotNull())
    gap = gap.select(F.col(ID).alias("_gap")).checkpoint(eager=True)
    # a null-safe join on ids that are not null: a plain one adds a filter that cleans every claim's id once more
    kept = r.services.join(gap, F.col(ID).eqNullSafe(F.col("_gap")), "left_semi")
    return kept.select(F.col("CLM_ID").alias("clm_id"), ID, "FROM_DATE")


@query("latest_per_group")  # W1
def q_latest_per_group(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    return cohorts.keep_group_extreme(o, ["o_custkey"], "o_orderdate", "max")


@query("top_priority_per_group")  # W2
def q_top_priority_per_group(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    return cohorts.keep_group_extreme(o, ["o_custkey"], "o_orderpriority", "min")
