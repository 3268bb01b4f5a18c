"""Incremental loading of extract files: closed periods are read once.

A store is a folder with the loaded rows (``data``, one sub-folder per load) and a
manifest: one row per file and version (path, size, modification time, load, rows).
A load lists the files, reads those whose path, size or time is not in the manifest,
writes their rows, and then appends their manifest rows.  Rows count only through the
manifest, so a load that failed before its last step leaves nothing behind, and the
next one reads the same files again.  A file that has changed replaces its old rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import SOURCE_FILE, load_audit, read_many

MANIFEST = "path string, size long, modified timestamp, load string, seq long, rows long"


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, size, modified) of the files behind some paths; their contents are not read."""
    d = spark.read.format("binaryFile").load(list(paths))
    return d.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """All versions of all files loaded so far."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{store}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current_files(spark: SparkSession, store: str) -> DataFrame:
    """The manifest's latest version of each file."""
    m = manifest(spark, store)
    last = m.groupBy("path").agg(F.max("seq").alias("seq"))
    return m.join(last, ["path", "seq"])


def load_new(spark: SparkSession, paths: Sequence[str], store: str, **reader) -> int:
    """Load the files that are new or changed; returns how many.  ``reader``: arguments of ``read_many``.

    The driver holds the paths of the new files, as any read does.  One load at a time may write to a store.
    """
    known = manifest(spark, store)
    files = list_files(spark, paths)
    new = files.join(current_files(spark, store).select("path", "size", "modified"), ["path", "size", "modified"], "left_anti").checkpoint(eager=True)
    todo = [r["path"] for r in new.select("path").toLocalIterator()]
    if not todo:
        return 0
    load, seq = uuid.uuid4().hex, (known.agg(F.max("seq")).first()[0] or 0) + 1
    read_many(spark, todo, **reader, keep_source=True).write.mode("overwrite").parquet(f"{store}/data/load={load}")
    rows = load_audit(spark.read.parquet(f"{store}/data/load={load}"))
    done = new.join(rows, _same_path(new["path"], rows[SOURCE_FILE]), "left").select(
        "path", "size", "modified", F.lit(load).alias("load"), F.lit(seq).cast("long").alias("seq"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
    done.coalesce(1).write.mode("append").parquet(f"{store}/manifest")   # one file, so that a load is in the manifest whole or not at all
    return len(todo)


def _same_path(a, b):
    """Equal but for the slashes after the scheme (``file:/x`` and ``file:///x``)."""
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    return plain(a) == plain(b)


def loaded(spark: SparkSession, store: str, keep_source: bool = False) -> DataFrame:
    """The rows of the current version of every file."""
    d = spark.read.option("basePath", f"{store}/data").parquet(f"{store}/data")
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
    now = current_files(spark, store).select(plain(F.col("path")).alias("_p"), F.col("load").alias("_l"))
    d = d.join(now, (plain(F.col(SOURCE_FILE)) == F.col("_p")) & (F.col("load") == F.col("_l")), "left_semi").drop("load")
    return d if keep_source else d.drop(SOURCE_FILE)


def audit(spark: SparkSession, store: str) -> DataFrame:
    """Rows loaded per current file, from the manifest alone."""
    return current_files(spark, store).select("path", "rows")
