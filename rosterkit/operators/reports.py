"""Report tables: the data behind the two summary reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import floor_month, round_ratio
from .schema import unique_names


def trailing_window(monthly: DataFrame, days: int = 365) -> DataFrame:
    """Monthly rows from the month of (latest month - ``days``) on.

    The latest month is a window over the whole monthly table, which is
    bounded by providers x months (not by the data volume); the table is
    read once.
    """
    latest = F.max("month_complete").over(Window.partitionBy())
    return (monthly.withColumn("_latest", latest)
            .where(F.col("month_complete") >= floor_month(F.date_sub(F.col("_latest"), days)))
            .drop("_latest"))


def trailing_months(monthly: DataFrame, days: int = 365) -> DataFrame:
    """Regional completions per month over the trailing window."""
    return trailing_window(monthly, days).groupBy("month_complete").agg(F.sum("n").alias("n"))


def month_facts(roster: DataFrame) -> DataFrame:
    """Per completion month (NULL month included): completions of eligible rows and rows due this FY.

    Bounded by the number of months; the inputs of M19/M20 in one roster pass.
    """
    r = roster.where(F.col("PROVIDER_NAME").isNotNull())
    return r.groupBy(floor_month("sis_completed_dt").alias("month_complete")).agg(
        F.count_if("sis_complete_elig").alias("n"),
        F.count_if(F.col("sis_eligible") & F.col("due_in_fy")).alias("n_due"))


def narrative_metrics(roster: DataFrame, days: int = 365) -> DataFrame:
    """One row: total due this FY, that over 12, last month's count, mean per month.

    "Last month" is the latest month with completions; the mean is over
    months that have completions (no zero months), as in the original.  The
    total due equals the summary's total row (eligible rows with a provider
    due this FY).  Computed from ``month_facts``: one roster pass.
    """
    m = month_facts(roster)
    whole = Window.partitionBy()
    m = m.withColumns({"_needed": F.sum("n_due").over(whole),
                       "_latest": F.max(F.when(F.col("n") > 0, F.col("month_complete"))).over(whole)})
    per_mo = m.where((F.col("n") > 0) & (F.col("month_complete") >= floor_month(F.date_sub("_latest", days))))
    return per_mo.agg(
        F.max("_needed").alias("needed"),
        round_ratio(F.max("_needed"), F.lit(12), 1).alias("needed_per_month"),
        F.max("month_complete").alias("last_month"),
        F.max_by("n", "month_complete").alias("last_month_n"),
        round_ratio(F.sum("n"), F.count(F.lit(1)), 1).alias("mean_per_month"),
    )


def priority_crosstab(worklist: DataFrame, providers: Sequence[str] | None = None,
                      total_name: str = "region_total", other_name: str = "n_other") -> DataFrame:
    """Count of worklist rows per priority (rows) and provider (columns) plus a total column.

    Columns are named ``n_<provider>`` (unique).  Rows of a provider that is
    not listed, or without one, are counted in ``other_name``; the total
    counts all rows.  ``providers=None`` takes the providers that occur, one
    driver row per provider.
    """
    if providers is None:
        found = worklist.select("PROVIDER_NAME").where(F.col("PROVIDER_NAME").isNotNull()).distinct()
        providers = sorted(r[0] for r in found.collect())
    p = F.col("PROVIDER_NAME")
    names = unique_names(providers, "n_", [total_name, other_name, "priority"])
    listed = F.coalesce(p.isin(list(providers)), F.lit(False)) if len(providers) else F.lit(False)
    return worklist.groupBy("priority").agg(
        *[F.count_if(F.coalesce(p == F.lit(v), F.lit(False))).alias(n) for v, n in zip(providers, names)],
        F.count_if(~listed).alias(other_name), F.count(F.lit(1)).alias(total_name))


def _fmt(c: str):
    """Thousands separator."""
    return F.format_number(F.col(c), 0)


def director_table(summary: DataFrame) -> DataFrame:
    """Organization, denominator, numerator, eligible, % complete, due this FY."""
    return summary.select(F.col("cmhsp").alias("organization"), _fmt("denominator").alias("denominator"),
                          _fmt("numerator").alias("numerator"), _fmt("eligible").alias("eligible"),
                          F.col("percent_complete"), _fmt("due_in_fy").alias("due_this_fy"))


def supervisor_table(summary: DataFrame) -> DataFrame:
    """The director columns plus completed, overdue and deferred."""
    return summary.select(F.col("cmhsp").alias("organization"), _fmt("denominator").alias("denominator"),
                          _fmt("numerator").alias("numerator"), _fmt("eligible").alias("eligible"),
                          F.col("percent_complete"), _fmt("due_in_fy").alias("due_this_fy"),
                          _fmt("completed_elig").alias("completed"), _fmt("overdue").alias("overdue"),
                          _fmt("deferred").alias("deferred"))


def dense_months(monthly: DataFrame, days: int = 365) -> DataFrame:
    """M19 with empty months (Q15): every provider and month of the trailing window, 0 where nothing was completed.

    The calendar runs from the window's first month to the latest month with data and is generated from these two
    dates, so it is bounded by ``days``, not by the data; each provider of the monthly table gets every month.
    """
    latest = monthly.agg(F.max("month_complete").alias("last")).where(F.col("last").isNotNull())
    months = latest.select(F.explode(F.sequence(floor_month(F.date_sub("last", days)), F.col("last"), F.expr("INTERVAL 1 MONTH"))).alias("month_complete"))
    grid = monthly.select("PROVIDER_NAME").distinct().join(F.broadcast(months))   # a few years of months at most
    own = monthly.select(F.col("PROVIDER_NAME").alias("_p"), F.col("month_complete").alias("_m"), "n")
    same = F.col("PROVIDER_NAME").eqNullSafe(F.col("_p")) & (F.col("month_complete") == F.col("_m"))
    return grid.join(own, same, "left").select("PROVIDER_NAME", "month_complete", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def trailing_months_dense(monthly: DataFrame, days: int = 365) -> DataFrame:
    """M19 over all months of the window: regional completions, and the mean per month that counts empty months."""
    d = dense_months(monthly, days).groupBy("month_complete").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy()   # one row per month
    return d.withColumn("mean_per_month", round_ratio(F.sum("n").over(whole), F.count(F.lit(1)).over(whole), 1))
