"""Spark session defaults for the library.

Every knob here is a plain Spark SQL conf. Nothing is hard-wired to local
mode: ``get_session`` only fills settings that are not already set, so a
cluster submit (spark-submit / spark-defaults) keeps its own values.
"""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings applied when the caller has not set them.  AQE re-plans joins at
# runtime from measured shuffle sizes (broadcast only when the measured side
# is below the threshold), coalesces small partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # size-checked broadcast: AQE converts a sort-merge join to a broadcast
    # join only when the *measured* shuffle output is below this size
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "rosterkit") -> SparkSession:
    """Return the active session untouched, or build one with the library defaults.

    Defaults are applied only to keys the submitted configuration
    (spark-defaults, ``--conf``) does not set, so a cluster keeps its own values.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    submitted = SparkConf()
    builder = SparkSession.builder.appName(app_name)
    if master and not submitted.contains("spark.master"):
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        if not submitted.contains(k):
            builder = builder.config(k, v)
    if shuffle_partitions and not submitted.contains("spark.sql.shuffle.partitions"):
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; without it, a folder of the SQL warehouse.

    Both are shared by the driver and all executors (HDFS / object store) and
    survive executor loss.  A warehouse in a machine-local folder is taken in
    local mode only: elsewhere other machines would not see it, so it raises.
    (The setting is static, so the fallback goes through the SparkContext.)
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        if is_machine_local(d) and not sc.master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share: {d} is local to one")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def is_machine_local(path: str) -> bool:
    """A path without a scheme, or of the local file system."""
    return "://" not in path and not path.startswith(("hdfs:", "s3:", "s3a:", "gs:", "abfs:", "abfss:")) or path.startswith("file:")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000   # rows with whole texts: a task's batch then is a few MB


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of BATCH_ROWS, unless the cluster or the session has its own number."""
    if not spark.sparkContext.getConf().contains(BATCH) and spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))


_SCOPES: list[list[str]] = []


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder; an enclosing ``scratch_scope`` deletes it."""
    path = os.path.join(ensure_checkpoint_dir(spark), name)
    for scope in _SCOPES[-1:]:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the intermediate tables that are made inside the block, when it ends.

    Results are lazy and read these tables, so write or collect them inside the block.
    Deletes through the file system that holds each table, so shared folders work too.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
