"""Completion summaries and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import count_true, floor_month, percent

def with_total(df: DataFrame, group: str, measures: dict[str, Column], label: str = C.TOTAL_LABEL,
               out_name: str | None = None) -> DataFrame:
    """Per-group measures plus one appended total row.

    The rows are reduced to one row per group first; the total is rolled up
    from that small result, so no input row is read or expanded twice.

    The total is recognised by ``grouping()``, not by a NULL key, because a
    NULL group is a real group.  All measures must be additive.
    """
    out_name = out_name or group
    per_group = df.groupBy(group).agg(*[m.alias(k) for k, m in measures.items()])
    agg = per_group.rollup(group).agg(*[F.sum(k).alias(k) for k in measures], F.grouping(group).alias("_g"))
    return agg.select(F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col(group)).alias(out_name),
                      *measures.keys(), F.col("_g").cast("int").alias("is_total"))


def completion_summary(roster: DataFrame, label: str = C.TOTAL_LABEL) -> DataFrame:
    """Per-provider completion counts with a regional total and rates.

    The ineligible-completed measure is always 0 here because the input is
    restricted to eligible rows first (kept for parity).  Counts are rows,
    so a person with two providers counts once per provider, and twice in
    the total, as in the original.
    """
    r = roster.where(F.col("PROVIDER_NAME").isNotNull() & F.col("sis_eligible"))
    t = with_total(r, "PROVIDER_NAME", {
        "eligible": count_true("sis_eligible"),
        "due_in_fy": count_true("due_in_fy"),
        "deferred": count_true("deferral_active"),
        "completed_elig": count_true("sis_complete_elig"),
        "completed_inel": count_true("sis_complete_inel"),
        "overdue": count_true("sis_overdue"),
    }, label, out_name="cmhsp")
    t = t.withColumns({
        "denominator": F.col("eligible") - F.col("deferred"),
        "denominator_fy": F.col("due_in_fy") - F.col("deferred"),
        "numerator": F.col("completed_elig") - F.col("overdue"),
    })
    t = t.withColumns({
        "percent_complete": percent("numerator", "denominator"),
        "percent_complete_fy": percent("numerator", "denominator_fy"),
    })
    return t.select(*C.SUMMARY_DISPLAY.keys(), "is_total")


def display_names(df: DataFrame, names: dict[str, str] = C.SUMMARY_DISPLAY, cols: Sequence[str] | None = None) -> DataFrame:
    """Select and rename to the report headers."""
    cols = list(cols) if cols is not None else [c for c in names if c in df.columns]
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in cols])


def in_order(df: DataFrame) -> DataFrame:
    """O2: providers in name order, the total row last (one row per provider)."""
    return df.orderBy("is_total", F.col("cmhsp").asc_nulls_first())


def monthly_completions(roster: DataFrame) -> DataFrame:
    """Completed assessments of eligible rows per provider and month."""
    r = roster.where(F.col("PROVIDER_NAME").isNotNull() & F.col("sis_complete_elig"))
    return (r.groupBy("PROVIDER_NAME", floor_month("sis_completed_dt").alias("month_complete"))
            .agg(F.count(F.lit(1)).alias("n")))


def fy_summary(fy_roster: DataFrame, label: str = C.TOTAL_LABEL) -> DataFrame:
    """Point-in-time denominator, completed, overdue, numerator and percent per provider."""
    r = fy_roster.where(F.col("sis_eligible") & (F.col("deferral") == F.lit(False)))
    t = with_total(r, "PROVIDER_NAME", {
        "denominator": count_true("sis_eligible"),
        "completed": count_true("sis_complete"),
        "overdue": count_true("sis_overdue"),
    }, label)
    t = t.withColumn("numerator", F.col("completed") - F.col("overdue"))
    t = t.withColumn("percent_complete", percent("numerator", "denominator"))
    return t.select("PROVIDER_NAME", "denominator", "completed", "overdue", "numerator", "percent_complete", "is_total")
