"""Sinks.

Writes are distributed: no sink gathers rows on the driver or in one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# A quote inside a field is doubled, as CSV readers expect.
CSV = {"header": "true", "quote": '"', "escape": '"'}


def _row_hash(df: DataFrame):
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def dated_path(base: str, as_of: dt.date | str) -> str:
    """``<base>_<YYYY-MM-DD>``: the run date is part of the output name (K1)."""
    d = as_of.isoformat() if isinstance(as_of, dt.date) else str(as_of)
    return f"{base}_{d}"


def write_csv(df: DataFrame, base: str, as_of, mode: str = "overwrite") -> str:
    """K1: CSV with a header under a date-stamped folder; returns the folder."""
    path = dated_path(base, as_of)
    df.write.options(**CSV).mode(mode).csv(path)
    return path


def write_split(df: DataFrame, by: str, base: str, order_desc: str, mode: str = "overwrite") -> str:
    """K2: one folder per value of ``by``; rows in each ordered by ``order_desc`` descending (NULL last).

    Range partitioning on (by, order) spreads a large group over several
    tasks; each task writes one ordered file, and a group's files in name
    order hold its rows in the requested order.  The group column is written
    into the files too (a copy named ``<by>_dir`` names the folders; a NULL
    group lands in Spark's default-partition folder).
    """
    part = f"{by}_dir"
    # ordered on the folder column itself: the writer needs its rows grouped
    # by that column and keeps an existing order that starts with it; a row
    # hash breaks ties so a run of equal (group, date) values can still be
    # split over several range partitions
    keys = [F.col(part).asc_nulls_last(), F.col(order_desc).desc_nulls_last(), F.col("_tie")]
    ordered = (df.withColumn(part, F.col(by)).withColumn("_tie", _row_hash(df))
               .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie"))
    ordered.write.options(**CSV).mode(mode).partitionBy(part).csv(base)
    return base


def with_row_number(df: DataFrame, order_by: Sequence, name: str = "row") -> DataFrame:
    """K3: consecutive 1-based row numbers in ``order_by`` order, computed distributedly.

    Range partitioning orders the partitions; within each, the position
    comes from ``monotonically_increasing_id`` (partition index in the high
    bits, record number in the low 33).  The numbered data is checkpointed
    into the shared checkpoint folder so both uses below see the same rows,
    then each partition is offset by the row count of the partitions before
    it (a table with one row per partition: a proven bound for the broadcast).
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    keys = [*order_by, F.col("_tie")]  # row hash: ties spread over range partitions
    pid = F.spark_partition_id()
    x = (df.withColumn("_tie", _row_hash(df)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
         .withColumn("_pid", pid)
         .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33))
         .checkpoint(eager=True))
    counts = x.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (x.join(F.broadcast(offsets), "_pid")
            .select((F.col("_off") + F.col("_local") + 1).alias(name), *[F.col(f"`{c}`") for c in df.columns]))


def write_csv_with_row_names(df: DataFrame, base: str, order_by: Sequence, mode: str = "overwrite") -> str:
    """K3: CSV whose first column numbers the rows (as a data frame's row names)."""
    with_row_number(df, order_by, "").write.options(**CSV).mode(mode).csv(base)
    return base
