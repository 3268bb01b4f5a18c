"""Cleaning and cohort operators.

Each takes a raw extract (as a reader or the stand-in adapter returns it)
and returns a lazy, typed DataFrame.  Row work is built-in column
expressions only; grouped operators aggregate with partial (map-side)
combine so a person or case with a third of all rows is reduced in every
map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import (
    age_on, cut_at_space, days_since, era_timestamp, excel_serial_to_date,
    floor_week_sunday, max_null_propagating, minutes_between, normalize_id, pad_then_normalize,
    parse_mdy, parse_mdy_hms, parse_mixed_date, parse_ymd, to_date_part, trim_ws, week_of_year, yes_no,
)
from .schema import clean_names, col_range, drop_all_null, drop_matching, map_cols, null_tokens, recode

ID = "MEDICAID_ID"


# -- M1 / M2: services ---------------------------------------------------------

def prep_services(raw: DataFrame, provider_recode=C.PROVIDER_RECODE, drop_empty_columns: bool = False) -> DataFrame:
    """M1: clean the claim-line extract.

    ``drop_empty_columns`` (C4) costs one extra pass over the input to learn
    which columns are all NULL; it is off by default for large inputs.
    """
    df = drop_all_null(raw) if drop_empty_columns else raw
    df = clean_names(df, "underscore")
    df = df.withColumn(ID, normalize_id(ID))
    id_like = [c for c in ("PRV_ID", "CON_ID") if c in df.columns]
    if "CLM_ID" in df.columns and "PRIM_INS_ID" in df.columns:
        id_like += col_range(df, "CLM_ID", "PRIM_INS_ID")
    df = map_cols(df, id_like, lambda c: c.cast("string"))
    df = df.withColumns({c: parse_mixed_date(c) for c in ("FROM_DATE", "THRU_DATE") if c in df.columns})
    if "HAB_WAIVER" in df.columns and "HMP_BUCKET" in df.columns:
        df = map_cols(df, col_range(df, "HAB_WAIVER", "HMP_BUCKET"), yes_no)
    return df.withColumn("PROVIDER_NAME", recode("PROVIDER_NAME", provider_recode))


def eligible_service_flag(services: DataFrame, codes: Sequence[str], payers: Sequence[str], cutoff=None):
    """Code in the eligible list and (payer in list or HMP eligible) [and on/before cutoff]."""
    cond = F.col("CPT_CD").isin(list(codes)) & (F.col("MEDICAID").isin(list(payers)) | F.col("HMP_ELIG"))
    if cutoff is not None:
        cond = cond & (F.col("FROM_DATE") <= F.lit(cutoff))
    return cond


def eligible_by_service(services: DataFrame, codes: Sequence[str] = C.ELIGIBLE_PROCEDURE_CODES,
                        payers: Sequence[str] = C.ELIGIBLE_PAYER_CODES, cutoff=None) -> DataFrame:
    """M2: first/last eligible service per (person, provider); ``eligible_svs`` = TRUE.

    A NULL person id is a group of its own, as in the original.
    """
    return (services.where(eligible_service_flag(services, codes, payers, cutoff))
            .groupBy(ID, "PROVIDER_NAME")
            .agg(F.min("FROM_DATE").alias("initial_service"), F.max("FROM_DATE").alias("most_recent_service"))
            .withColumn("eligible_svs", F.lit(True)))


def service_person_provider(services: DataFrame, codes: Sequence[str], payers: Sequence[str], cutoff=None,
                            keep_null_id: bool = False, with_span: bool = False) -> DataFrame:
    """All (person, provider) pairs of the services with their eligible-service span.

    One aggregation serves both the roster's person spine (every person
    with any service) and ``eligible_by_service`` (pairs with
    ``eligible_svs``), so the claim lines are scanned and shuffled once.
    The NULL id group is dropped unless ``keep_null_id``.  ``with_span``
    adds the span of all service dates (``_n`` rows, ``_nd`` dated rows,
    ``_mn``/``_mx``), used by the coverage check.
    """
    flag = eligible_service_flag(services, codes, payers, cutoff)
    d = F.col("FROM_DATE")
    aggs = [F.bool_or("_elig").alias("eligible_svs"),
            F.min(F.when(F.col("_elig"), F.col("_d"))).alias("initial_service"),
            F.max(F.when(F.col("_elig"), F.col("_d"))).alias("most_recent_service"),
            F.bool_or(F.col(ID).isNotNull()).alias("_has_id")]
    if with_span:
        aggs += [F.count(F.lit(1)).alias("_n"), F.count("_d").alias("_nd"), F.min("_d").alias("_mn"),
                 F.max("_d").alias("_mx")]
    pairs = (services
             .select(ID, "PROVIDER_NAME", F.coalesce(flag, F.lit(False)).alias("_elig"), d.alias("_d"))
             .groupBy(ID, "PROVIDER_NAME").agg(*aggs))
    # The NULL id group is dropped through an aggregate output: a filter on
    # the id itself would be pushed below the aggregate and inlined (with the
    # whole id-cleaning expression) into the scan side, cleaning every id twice.
    if not keep_null_id:
        pairs = pairs.where(F.col("_has_id"))
    return pairs.drop("_has_id")


# -- M3 / M4: attributes -----------------------------------------------------------

def prep_attributes(raw: DataFrame) -> DataFrame:
    """M3: clean the quality-indicator file."""
    df = clean_names(raw, "strip").withColumnRenamed("MEDICAID_RECIP_ID", ID)
    df = df.withColumn(ID, normalize_id(ID))
    if "DISABILITYDD" in df.columns and "MAJOR_MENTAL_ILLNESS" in df.columns:
        df = map_cols(df, col_range(df, "DISABILITYDD", "MAJOR_MENTAL_ILLNESS", exclude=["DATE_OF_BIRTH"]),
                      lambda c: c.cast("string"))
    return df.withColumn("DATE_OF_BIRTH", parse_ymd("DATE_OF_BIRTH"))


def eligible_by_attributes(attrs: DataFrame, as_of, min_age: float = 18, days_per_year: float = 365.25,
                           blank_uses_proxies: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """M4: IDD flag 1, or any of three proxy measures populated; adult at ``as_of``.

    An explicit '2' excludes.  As in the original code a blank flag is
    dropped by the first test (``blank_uses_proxies=True`` follows the
    original comment instead: blank falls through to the proxies).  ``keep``:
    further columns of the result.
    """
    idd = F.col("DISABILITYDD")
    not_no = (idd != "2") | idd.isNull() if blank_uses_proxies else (idd != "2")
    proxies = F.col("MOBILITY").isNotNull() | F.col("PERSONAL").isNotNull() | F.col("SUPPORT_SYSTEM").isNotNull()
    return (attrs.where(not_no)
            .where((idd == "1") | proxies)
            .where(age_on("DATE_OF_BIRTH", as_of, days_per_year) >= F.lit(min_age))
            .select(ID, F.lit(True).alias("eligible_qi"), *keep))


# -- M5 / M6: assessments ------------------------------------------------------------

def prep_assessments(raw: DataFrame, as_of, clock_format_change=C.CLOCK_FORMAT_CHANGE,
                     tokens: Sequence[str] = C.ASSESSMENT_NULL_TOKENS) -> DataFrame:
    """M5: clean the completed-assessment sheet.

    The sheet's first column is the assessment id.  (Dropping the sheet's
    description row is a reader concern: see ``sources.files.read_many``.)
    """
    df = null_tokens(raw, tokens)
    df = df.withColumnRenamed(df.columns[0], "sis_id")
    df = df.where(F.col("statusText") == C.COMPLETED_STATUS)
    df = drop_matching(df, suffix="notes")
    done = excel_serial_to_date(cut_at_space("sis_completed_dt"))
    df = df.withColumn("sis_completed_dt", done)
    df = df.withColumns({
        "start": era_timestamp("sis_completed_dt", "sis_startTime", clock_format_change),
        "end": era_timestamp("sis_completed_dt", "sis_endTime", clock_format_change),
        "sis_cl_dob_dt": parse_mdy_hms("sis_cl_dob_dt", truncated=3),
        "statusChangeDate": parse_mdy_hms("statusChangeDate"),
        "dateUpdated": parse_mdy_hms("dateUpdated"),
        "isp_begin_date": parse_mdy("isp_begin_date"),
    })
    completed_ts = F.col("sis_completed_dt").cast("timestamp_ntz")
    return df.withColumns({
        "duration": minutes_between("start", "end"),
        "DaysSince": days_since("sis_completed_dt", as_of),
        "age": F.floor(F.timestamp_diff("SECOND", F.col("sis_cl_dob_dt"), completed_ts)
                       / F.lit(86400.0 * 365.242)),
        "sis_wk": week_of_year("sis_completed_dt"),
        "sis_yr": F.year("sis_completed_dt"),
        "sis_yrwk": floor_week_sunday("sis_completed_dt"),
        "mcaid_id": normalize_id("sis_track_num"),
    })


def latest_assessment(assessments: DataFrame, cutoff=None) -> DataFrame:
    """M6: most recent completion date per person; a NULL date in the group gives NULL."""
    a = assessments.select("mcaid_id", "sis_completed_dt")
    if cutoff is not None:
        a = a.where(F.col("sis_completed_dt") <= F.lit(cutoff))
    return a.groupBy("mcaid_id").agg(max_null_propagating("sis_completed_dt").alias("sis_completed_dt"))


# -- M7: deferrals ----------------------------------------------------------------------

def union_sources(sources: Sequence[tuple[DataFrame, str, str, str]], id_col: str = ID,
                  date_col: str = "defer_date") -> DataFrame:
    """One parametrised select per source, then union by name.

    ``kind`` is ``'datetime'`` (date part of a timestamp) or ``'serial'``
    (spreadsheet day number).  Ids are zero-padded to 10 before anything else.
    """
    parts = []
    for df, key, date, kind in sources:
        d = F.col(f"`{date}`")
        day = to_date_part(d) if kind == "datetime" else excel_serial_to_date(d)
        parts.append(df.select(F.col(f"`{key}`").cast("string").alias(id_col), day.alias(date_col)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def prep_deferrals(sources: Sequence[tuple[DataFrame, str, str, str]], as_of, days: int = 365) -> DataFrame:
    """M7: deferrals with an active flag (active while ``defer_date + days >= as_of``)."""
    df = union_sources(sources).withColumn(ID, pad_then_normalize(ID))
    end = F.date_add("defer_date", days)
    a = F.lit(as_of)
    active = (F.when(end < a, F.lit(False))
              .when(F.col("defer_date").isNull(), F.lit(False))
              .when(end >= a, F.lit(True)))
    return df.withColumns({"deferral": F.lit(True), "deferral_active": active})


# -- M8: admissions ------------------------------------------------------------------------

def keep_group_extreme(df: DataFrame, keys: Sequence[str], value, how: str = "max",
                       value_name: str = "_v") -> DataFrame:
    """Rows whose ``value`` equals the group's max (or min); ties kept.

    Built as aggregate + join instead of a window, so no task ever holds a
    whole group: the aggregate combines map-side, and the join is on
    (keys, value), which spreads a hot key's rows by value.  NULL values are
    dropped (they never equal the extreme); NULL keys form a group.
    """
    v = value if not isinstance(value, str) else F.col(value)
    x = df.withColumn(value_name, v)
    agg = F.max(value_name) if how == "max" else F.min(value_name)
    ext = x.groupBy(*keys).agg(agg.alias(value_name))
    cond = [x[k].eqNullSafe(ext[k]) for k in keys] + [x[value_name] == ext[value_name]]
    return x.join(ext, cond, "left_semi").drop(value_name)


def open_admissions(raw: DataFrame, compare_as: str = "date") -> DataFrame:
    """M8: admission date of each case's most recent service start (ties kept).

    ``compare_as='date'`` parses the start date first; ``'string'`` compares
    the text as the original does.  The id is not normalised here.
    """
    df = drop_matching(raw, prefix="X_")
    df = clean_names(df, "lower")
    ssd = F.col("service_start_date")
    key = parse_mixed_date(ssd) if compare_as == "date" else ssd
    latest = keep_group_extreme(df, ["case_number"], key, "max")
    return latest.select("medicaid_id", parse_mdy(trim_ws("agency_admission_date")).alias("agency_admission_date"))
