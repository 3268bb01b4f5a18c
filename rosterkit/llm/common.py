"""Small helpers shared by the operators: word rules, column clashes, tables in the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches, checkpoint_path

# the C library's call for it, where there is one
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

# A word is a run of characters other than space, tab, LF, VT, FF and CR
# (what ``bytes.split()`` cuts at in UTF-8 text).
WORD = r"[^\x20\x09-\x0D]+"

# Tables up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 100_000


def whole_text(col: str | Column = "text") -> Column:
    """The text; null is the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(col: str | Column = "text") -> Column:
    return F.regexp_count(whole_text(col), F.lit(WORD)).cast("long")


def lower_az(col: Column) -> Column:
    """Lower-case A-Z only (other letters keep their case)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(col: Column) -> Column:
    """Array of the words of a text (never holds empty strings)."""
    return F.filter(F.split(col, r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def keep_clear(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename input columns that clash with an operator's output: ``x`` becomes ``x_in`` (``x_in_in`` ...)."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in names}
    for c in df.columns:
        if c.lower() in {n.lower() for n in names}:
            new = c + "_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            df = df.withColumnRenamed(c, new)
    return df


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row count has been checked; a larger one joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back (lineage cut).

    The copy survives lost executors; later jobs read it and do not recompute
    what is above it.  The write's own shuffle files go when it ends.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = path or scratch(spark, name)
    with freed_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"   # Spark 4.1; earlier ones ignore it


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Spark deletes the shuffle files of every query that ends inside the block, not only when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; ``session.scratch_scope`` removes it."""
    return checkpoint_path(spark, f"llm-{uuid.uuid4().hex}/{name}")


def give_back() -> None:
    """Return freed memory to the system: a worker is used again by tasks that need little."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run):
    """A function of a task's batches that gives freed memory back when the task ends."""
    @wraps(run)
    def task(batches):
        yield from run(batches)
        give_back()
    return task


def tidy_group(one):
    """A function of a group (one table, or two that were grouped together) that gives freed memory back when it is done."""
    def done(out: pa.Table) -> pa.Table:
        give_back()
        return out

    if one.__code__.co_argcount == 1:
        return lambda t: done(one(t))
    return lambda left, right: done(one(left, right))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
