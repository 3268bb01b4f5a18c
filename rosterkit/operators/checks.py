"""Reconciliation and coverage checks.

The reconciliation takes the two tables it compares, reduces each to one row
per person (map-side combine) and compares those.  Callers that derive both
from one roster cut its lineage first (``Run.checkpoint_roster``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import any_true
from .cohorts import ID
from .worklist import row_priority

FLAGS = ("sis_overdue", "sis_coming90", "due_in_fy")


def flagged_not_in_worklist(roster: DataFrame, worklist: DataFrame) -> DataFrame:
    """M24 rows: roster rows of people absent from the worklist with an upcoming / overdue flag."""
    ids = worklist.select(F.col(ID).alias("_wid")).distinct()
    return roster.where(any_true(*FLAGS)).join(ids, F.col(ID).eqNullSafe(F.col("_wid")), "left_anti")


def reconcile(roster: DataFrame, worklist: DataFrame) -> DataFrame:
    """M24 counts: people and rows missing from the worklist; worklist ids; worklist ids in the roster."""
    no, none = F.lit(False), F.lit(0).cast("long")
    r = roster.groupBy(ID).agg(F.count_if(any_true(*FLAGS)).alias("n_flagged")).select(
        ID, F.lit(True).alias("in_roster"), no.alias("in_work"), "n_flagged")
    w = worklist.select(ID).distinct().select(ID, no.alias("in_roster"), F.lit(True).alias("in_work"), none.alias("n_flagged"))
    person = r.unionByName(w).groupBy(ID).agg(
        F.bool_or("in_roster").alias("in_roster"), F.bool_or("in_work").alias("in_work"), F.max("n_flagged").alias("n_flagged"))
    missing = F.col("in_roster") & ~F.col("in_work") & (F.col("n_flagged") > 0)
    return person.agg(
        F.count_if(missing).alias("n_people_missing"),
        F.coalesce(F.sum(F.when(missing, F.col("n_flagged"))), F.lit(0)).alias("n_rows_missing"),
        F.count_if("in_work").alias("n_worklist_ids"),
        F.count_if(F.col("in_work") & F.col("in_roster")).alias("n_worklist_ids_in_roster"))


def ids_without_admission(ids: DataFrame, admissions: DataFrame) -> DataFrame:
    """U4: distinct ids (NULL is one value) that have no admission record."""
    # both sides are reduced to distinct ids (map-side combine) before they meet
    adm = admissions.select(F.col("medicaid_id").alias(ID)).distinct()
    return ids.select(ID).distinct().subtract(adm)


def coverage_gap(services: DataFrame, elig_attr: DataFrame, assessments: DataFrame, deferrals: DataFrame,
                 admissions: DataFrame, cfg) -> DataFrame:
    """One row of coverage-gap metrics.

    Service ids and worklist ids without an admission record (set
    difference; a NULL id is one value), the service-date span of the
    worklist gap, the overall first service date and the NULL counts of the
    admission table.  Dates use NULL-propagating min/max, as the original
    writes them without removing missing values.

    One pass over the claims: the roster is built in keep-all mode from a
    spine that also carries each person's service-date span (and the NULL-id
    group), so the worklist membership and the service side come from the
    same rows.  Per-person facts (no shuffle: the rows are partitioned by
    person) are unioned with the admission rows and grouped by person once;
    a global aggregate then yields the row.
    """
    from .cohorts import service_person_provider
    from .roster import person_spine, roster_rows

    pairs = service_person_provider(services, cfg.procedure_codes, cfg.payer_codes, keep_null_id=True,
                                    with_span=True)
    spine = person_spine(pairs, elig_attr, assessments, with_span=True)
    rows = row_priority(roster_rows(spine, deferrals, admissions, cfg, keep_all=True))
    nd = F.lit(None).cast("date")
    z = F.lit(0).cast("long")
    person = rows.groupBy(ID).agg(
        F.coalesce(F.max("svc_n"), z).alias("_n"), F.coalesce(F.max("svc_nd"), z).alias("_nd"),
        F.min("svc_min").alias("_mn"), F.max("svc_max").alias("_mx"),
        F.bool_or(F.col("_in_roster") & F.col("_rank").isNotNull()).cast("int").alias("_w"))
    person = person.select(ID, (F.col("_n") > 0).cast("int").alias("_s"), "_w", F.lit(0).alias("_a"), "_n", "_nd",
                           "_mn", "_mx", z.alias("_adm_null_date"))
    adm = admissions.select(F.col("medicaid_id").alias(ID), F.lit(0).alias("_s"), F.lit(0).alias("_w"),
                            F.lit(1).alias("_a"), z.alias("_n"), z.alias("_nd"), nd.alias("_mn"), nd.alias("_mx"),
                            F.col("agency_admission_date").isNull().cast("long").alias("_adm_null_date"))
    p = (person.unionByName(adm).groupBy(ID)
         .agg(F.max("_s").alias("s"), F.max("_w").alias("w"), F.sum("_a").alias("a"),
              F.sum("_n").alias("n"), F.sum("_nd").alias("nd"), F.min("_mn").alias("mn"), F.max("_mx").alias("mx"),
              F.sum("_adm_null_date").alias("adm_null_date")))
    in_svs, in_work, in_adm = F.col("s") == 1, F.col("w") == 1, F.col("a") > 0
    gap = in_work & ~in_adm & in_svs
    complete = F.col("n") == F.col("nd")
    return p.agg(
        F.count_if(in_svs & ~in_adm).alias("n_service_ids_without_admission"),
        F.count_if(in_work & ~in_adm).alias("n_worklist_ids_without_admission"),
        F.when(F.count_if(gap & ~complete) == 0, F.min(F.when(gap, F.col("mn")))).alias("gap_first_service"),
        F.when(F.count_if(gap & ~complete) == 0, F.max(F.when(gap, F.col("mx")))).alias("gap_last_service"),
        F.when(F.count_if(in_svs & ~complete) == 0, F.min(F.when(in_svs, F.col("mn")))).alias("first_service"),
        F.coalesce(F.sum(F.when(F.col(ID).isNull(), F.col("a"))), F.lit(0)).cast("long").alias("n_null_admission_id"),
        F.coalesce(F.sum("adm_null_date"), F.lit(0)).cast("long").alias("n_null_admission_date"))
