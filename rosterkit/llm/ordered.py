"""Consecutive numbers for the rows of a sorted table, and runs of rows streamed in order.

A group of any size is spread over the range partitions that its rows fall into;
no window gathers it in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut


def in_order(df: DataFrame, order: list[str], ties: bool = True) -> DataFrame:
    """Range partitions, each sorted, of the ascending order (nulls first) of some columns.

    Rows that are equal in all of them (``ties``) are spread by their place in the input, so ``df`` then is a table
    or made from one row by row, which a lost task reads again in the same order.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    if not ties:
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    keys.append(F.col("_tie"))
    return df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")


def offsets(parts: DataFrame, value: str) -> DataFrame:
    """(_pid, before): what the partitions before each have together; ``parts`` has one row per partition."""
    total = F.sum(F.col(value).cast("decimal(38,0)"))
    return parts.select("_pid", (total.over(Window.orderBy("_pid")) - F.col(value).cast("decimal(38,0)")).alias("before"))


def numbered(df: DataFrame, order: list[str], row: str, name: str, ties: bool = True) -> DataFrame:
    """The rows with ``row``: their place, from 0, in ascending order of some columns; cut into the shared folder.

    A partition's first number is the count of the rows before it; these counts
    are a table of one row per partition, the bound of its broadcast.
    """
    pid = F.spark_partition_id()
    d = in_order(df, order, ties).withColumn("_pid", pid).withColumn(
        "_local", F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33))
    d = cut(d, name)
    before = offsets(d.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")), "n")
    d = d.join(F.broadcast(before), "_pid")
    return d.withColumn(row, F.col("_local") + F.col("before").cast("long")).drop("_pid", "_local", "before")


def runs(batches: Iterator[pa.RecordBatch], key: Callable[[dict], tuple]) -> Iterator[tuple[tuple, dict]]:
    """(key, row) of the rows of a sorted partition, batch by batch."""
    for b in batches:
        for r in b.to_pylist():
            yield key(r), r
