"""Mergeable distinct counts of people: theta sketches per provider and month.

A theta sketch keeps the smallest hashes of the ids it has seen, at most 2**lg_nominal
of them, so it has a fixed size; sketches of any two parts of the data can be united,
intersected or subtracted, and kept between runs.  Up to 2**lg_nominal distinct ids the
count is exact; beyond, the relative standard error of one sketch is about 1 / sqrt(2**lg_nominal - 1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import floor_month
from .cohorts import ID

LG_NOMINAL = 12


def bound(estimate, lg_nominal: int = LG_NOMINAL, sigmas: float = 3.0) -> Column:
    """How far an estimate of one or a union of sketches may be off: 0 while it is exact."""
    k = 2 ** lg_nominal
    c = F.col(estimate) if isinstance(estimate, str) else estimate
    return F.when(c <= k, F.lit(0.0)).otherwise(c * F.lit(sigmas / math.sqrt(k - 1)))


def people_sketches(services: DataFrame, lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """(PROVIDER_NAME, month, sketch): the people served, a NULL id left out; one row per provider and month."""
    s = services.where(F.col(ID).isNotNull())
    return s.groupBy("PROVIDER_NAME", floor_month("FROM_DATE").alias("month")).agg(F.theta_sketch_agg(ID, F.lit(lg_nominal)).alias("sketch"))


def unite(sketches: DataFrame, by: list[str], lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """One sketch per group of ``by``: the people of any of its rows (also of sketches stored by earlier runs)."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", F.lit(lg_nominal)).alias("sketch"))


def estimate(sketches: DataFrame, name: str = "n_people", lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """The sketches' estimates and bounds (``<name>_bound``), without the sketches."""
    out = sketches.withColumn(name, F.theta_sketch_estimate("sketch"))
    return out.withColumn(name + "_bound", bound(name, lg_nominal)).drop("sketch")


def kept_from_month_to_month(sketches: DataFrame, lg_nominal: int = LG_NOMINAL) -> DataFrame:
    """Per provider and month: people, those also served the month before, and those not seen then.

    Joins a provider's month with the one before; an absent month has nobody.
    """
    before = sketches.select(F.col("PROVIDER_NAME").alias("_p"), F.add_months("month", 1).alias("_m"), F.col("sketch").alias("_before"))
    same = F.col("PROVIDER_NAME").eqNullSafe(F.col("_p")) & (F.col("month") == F.col("_m"))
    d = sketches.join(before, same, "left")
    both = F.when(F.col("_before").isNotNull(), F.theta_sketch_estimate(F.theta_intersection("sketch", "_before"))).otherwise(F.lit(0))
    new = F.when(F.col("_before").isNotNull(), F.theta_sketch_estimate(F.theta_difference("sketch", "_before"))).otherwise(F.theta_sketch_estimate("sketch"))
    n = F.theta_sketch_estimate("sketch")
    return d.select("PROVIDER_NAME", "month", n.alias("n_people"), both.cast("long").alias("n_kept"), new.cast("long").alias("n_new"),
                    bound(n, lg_nominal).alias("n_people_bound"))
