"""The point-in-time summary at many run dates in one pass.

At a run date D, a (person, provider) pair counts when the person is eligible by
attributes on D, was never deferred, and had a first eligible service up to D.  It
is completed when an assessment was completed up to D, and overdue when the
latest one is more than ``reassess_days_fy`` days old.  Each pair is therefore a few
dated changes of three counts (+1 or -1); a summary at D is the sum of all changes
up to D.  Claims are read once, whatever the number of run dates.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RunConfig
from ..functions import percent
from .cohorts import ID, eligible_by_service

MEASURES = ("denominator", "completed", "overdue")


def adult_from(birth, cfg: RunConfig):
    """The first day on which ``age_on(birth, day) >= min_age``."""
    return F.date_add(birth, math.ceil(cfg.min_age * cfg.days_per_year))


def pair_changes(services: DataFrame, attributes: DataFrame, assessments: DataFrame, deferrals: DataFrame,
                 cfg: RunConfig) -> DataFrame:
    """(PROVIDER_NAME, day, denominator, completed, overdue): what changes on which day, one row per change.

    ``attributes``: (id, eligible_from), the day from which a person is eligible by attributes, one row per
    row of the attribute file.  A person's completion days are few; a pair's changes are made from their list.
    """
    first = eligible_by_service(services, cfg.procedure_codes, cfg.payer_codes)
    first = first.where(F.col(ID).isNotNull() & F.col("initial_service").isNotNull()).select(ID, "PROVIDER_NAME", "initial_service")
    deferred = deferrals.where(F.col(ID).isNotNull()).select(ID).distinct()
    done = assessments.where(F.col("sis_completed_dt").isNotNull()).groupBy(F.col("mcaid_id").alias(ID)).agg(
        F.sort_array(F.collect_set("sis_completed_dt")).alias("days"))
    p = first.join(attributes, ID).join(deferred, ID, "left_anti").join(done, ID, "left")
    start = F.greatest("initial_service", "eligible_from")
    change = lambda day, d, c, o: F.struct(day.alias("day"), F.lit(d).alias("denominator"), F.lit(c).alias("completed"), F.lit(o).alias("overdue"))
    days = F.coalesce("days", F.array().cast("array<date>"))
    after = F.transform(days, lambda x, i: F.struct(x.alias("day"), F.try_element_at(days, i + 2).alias("next")))
    # overdue from the day after a completion's term until the next completion, as far as the pair counts by then
    due = lambda x: F.greatest(F.date_add(x["day"], cfg.reassess_days_fy + 1), F.col("start"))
    lapses = F.filter(after, lambda x: x["next"].isNull() | (due(x) < x["next"]))
    p = p.withColumn("start", start).select("PROVIDER_NAME", "start", F.concat(
        F.array(change(F.col("start"), 1, 0, 0)),
        F.when(F.size(days) > 0, F.array(change(F.greatest(F.col("start"), F.element_at(days, 1)), 0, 1, 0))).otherwise(F.array()),
        F.transform(lapses, lambda x: change(due(x), 0, 0, 1)),
        F.transform(F.filter(lapses, lambda x: x["next"].isNotNull()), lambda x: change(x["next"], 0, 0, -1))).alias("changes"))
    return p.select("PROVIDER_NAME", F.explode("changes").alias("c")).select("PROVIDER_NAME", "c.day", *[f"c.{m}" for m in MEASURES])


def attribute_start(attributes: DataFrame, cfg: RunConfig) -> DataFrame:
    """(id, eligible_from): rows that pass the attribute test, with the day on which the person is of age."""
    from .cohorts import eligible_by_attributes
    # eligible at any date: the test without age, then the day of coming of age
    with_birth = attributes.where(F.col("DATE_OF_BIRTH").isNotNull())
    kept = eligible_by_attributes(with_birth, dt.date(9000, 1, 1), cfg.min_age, cfg.days_per_year, cfg.blank_uses_proxies, keep=["DATE_OF_BIRTH"])
    return kept.where(F.col(ID).isNotNull()).select(ID, adult_from(F.col("DATE_OF_BIRTH"), cfg).alias("eligible_from"))


def summary_at(changes: DataFrame, dates: Sequence[dt.date], label: str) -> DataFrame:
    """One row per run date and provider seen by then, and a total row per date.

    Changes are first added up per provider and run date they come before (map-side combine), then summed
    along each provider's dates: that window holds providers x dates rows, not changes.
    """
    dates = sorted(set(dates))
    spark = changes.sparkSession
    ends = F.array(*[F.lit(d) for d in dates])
    # the first run date on or after the day; changes after the last one count nowhere
    slot = F.array_min(F.filter(ends, lambda d: d >= F.col("day")))
    per = changes.withColumn("run_date", slot).where(F.col("run_date").isNotNull()).groupBy("PROVIDER_NAME", "run_date").agg(
        *[F.sum(m).alias(m) for m in MEASURES])
    grid = per.select("PROVIDER_NAME").distinct().join(F.broadcast(spark.createDataFrame([(d,) for d in dates], "run_date date")))
    same = F.col("g.PROVIDER_NAME").eqNullSafe(F.col("p.PROVIDER_NAME")) & (F.col("g.run_date") == F.col("p.run_date"))
    full = grid.alias("g").join(per.alias("p"), same, "left").select("g.PROVIDER_NAME", "g.run_date", *[F.coalesce(f"p.{m}", F.lit(0)).alias(m) for m in MEASURES])
    w = Window.partitionBy("PROVIDER_NAME").orderBy("run_date")
    full = full.select("PROVIDER_NAME", "run_date", *[F.sum(m).over(w).alias(m) for m in MEASURES]).where("denominator > 0")
    total = full.groupBy("run_date").agg(*[F.sum(m).alias(m) for m in MEASURES])
    out = full.withColumn("is_total", F.lit(0)).unionByName(
        total.select(F.lit(label).alias("PROVIDER_NAME"), "run_date", *MEASURES, F.lit(1).alias("is_total")))
    out = out.withColumn("numerator", F.col("completed") - F.col("overdue"))
    return out.select("run_date", "PROVIDER_NAME", *MEASURES, "numerator", percent("numerator", "denominator").alias("percent_complete"), "is_total")


def month_ends(first: dt.date, last: dt.date) -> list[dt.date]:
    """The last days of the months from ``first`` to ``last``, as far as they are in this span."""
    out, y, m = [], first.year, first.month
    while (y, m) <= (last.year, last.month):
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
        day = dt.date(y, m, 1) - dt.timedelta(days=1)
        if first <= day <= last:
            out.append(day)
    return out
