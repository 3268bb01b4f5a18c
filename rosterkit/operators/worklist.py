"""Priority worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from .cohorts import ID

WORKLIST_COLUMNS = [ID, "PROVIDER_NAME", "agency_admission_date", "most_recent_service", "due_by_dt",
                    "sis_completed_dt"]


def _rank_candidates():
    """(rank, status, condition) for every kept status, in priority order."""
    return [
        (1, C.STATUS_INITIAL, F.col("sis_complete_any") == F.lit(False)),
        (2, C.STATUS_OVERDUE, F.col("sis_overdue") == F.lit(True)),
        (3, C.STATUS_COMING, F.col("sis_coming90") == F.lit(True)),
        (4, C.STATUS_IN_FY, F.col("due_in_fy") == F.lit(True)),
        (5, C.STATUS_EXPIRED_DEFERRAL, F.col("deferral_active") == F.lit(False)),
    ]


def row_priority(roster: DataFrame) -> DataFrame:
    """Roster rows with ``_rank``: the row's best kept status rank (NULL: nothing to do).

    Rows without a provider never enter the worklist.
    """
    best = F.least(*[F.when(cond, F.lit(rank)) for rank, _, cond in _rank_candidates()])
    return roster.withColumn("_rank", F.when(F.col("PROVIDER_NAME").isNotNull(), best))


def worklist(roster: DataFrame, dense_priority: bool = False, spread: bool = False) -> DataFrame:
    """Each person's highest-priority open issue, one row per roster row that has it.

    The original unpivots six flags into (field, value) rows, labels each,
    drops excluded labels and keeps the rows at the person's best rank.  A
    row never carries two kept statuses of the same rank, so that equals:
    best rank per row (``least`` over the kept conditions), then rows whose
    best rank equals the person's minimum.  No 6x expansion.  The minimum is
    a window on the person key, which the roster is already partitioned by:
    no extra shuffle, and the roster is computed once.

    ``spread=True`` is for rosters in which a person's rows are spread over
    tasks: the minimum is an aggregate (map-side combined) joined back, and a
    person's rows stay where they are or are split by the skew join.

    ``dense_priority=True`` numbers the ranks among the statuses present in
    the result (the original's factor levels) instead of the fixed 1..5.
    """
    rows = row_priority(roster).where(F.col("_rank").isNotNull())
    if spread:
        least = rows.groupBy(F.col(ID).alias("_wid")).agg(F.min("_rank").alias("_min"))
        kept = rows.join(least, F.col(ID).eqNullSafe(F.col("_wid")) & (F.col("_rank") == F.col("_min")))
    else:
        kept = (rows.withColumn("_min", F.min("_rank").over(Window.partitionBy(ID)))
                .where(F.col("_rank") == F.col("_min")))
    label = F.element_at(F.array(*[F.lit(s) for _, s, _ in _rank_candidates()]), F.col("_rank"))
    out = kept.select(*WORKLIST_COLUMNS, label.alias("status"), label.alias("priority"),
                      F.col("_rank").cast("int").alias("n_priority"))
    if dense_priority:
        # at most five rows (one per kept status), so the window and the
        # broadcast side are bounded by the number of statuses
        present = out.select("n_priority").distinct()
        dense = present.select("n_priority", F.dense_rank().over(Window.orderBy("n_priority")).alias("_d"))
        out = out.join(F.broadcast(dense), "n_priority").withColumn("n_priority", F.col("_d").cast("int")).drop("_d")
        out = out.select(*WORKLIST_COLUMNS, "status", "priority", "n_priority")
    return out


def fy_worklist(fy_roster: DataFrame) -> DataFrame:
    """Point-in-time worklist: eligible, never deferred, and not assessed or overdue.

    The 30-day status is computed by the original and then filtered out;
    the first matching status wins (no per-person reduction).
    """
    r = fy_roster.where(F.col("sis_eligible") & (F.col("deferral") == F.lit(False)))
    r = r.where((F.col("sis_complete") == F.lit(False)) | F.col("sis_overdue") | F.col("sis_coming30"))
    status = (F.when(F.col("sis_complete") == F.lit(False), F.lit(C.STATUS_INITIAL))
              .when(F.col("sis_overdue"), F.lit(C.STATUS_OVERDUE))
              .when(F.col("sis_coming30"), F.lit(C.STATUS_COMING_30)))
    r = r.withColumn("status", status).where(F.col("status").isin(list(C.FY_KEPT_STATUSES)))
    return r.select(ID, "PROVIDER_NAME", "initial_service", "most_recent_service", "status")
