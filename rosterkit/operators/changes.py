"""Differences between two runs of a table: what was added, closed or changed.

Rows are matched by a key.  A key may have several rows (a person with two providers or equal
rows), so rows are compared as multisets: each distinct content of a key is counted on
both sides, in one shuffle of both tables together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cohorts import ID

WORKLIST_KEY = (ID, "PROVIDER_NAME")


def row_changes(before: DataFrame, after: DataFrame, key: Sequence[str] = WORKLIST_KEY, state: str = "status") -> DataFrame:
    """One row per key that differs: ``kind`` is added, closed, status (its states changed) or details (others did).

    Columns: the key, kind, n_before and n_after (rows), ``<state>_before`` and ``<state>_after`` (sorted, joined by
    commas).  Repeated rows count: a key with two equal rows before and one after has changed (details).  A NULL in the
    key or elsewhere is a value like others.  Contents are compared by two 64-bit hashes of all columns.
    """
    names = before.columns
    if sorted(names) != sorted(after.columns):
        raise ValueError(f"columns differ: {sorted(names)} and {sorted(after.columns)}")
    # nulls are hashed as their own value: xxhash64 skips them, so each column goes in with its null flag
    content = [c for n in names for c in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))]
    def side(df, sign):
        return df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)], F.col(f"`{state}`").alias("_state"),
                         F.xxhash64(F.lit(1), *content).alias("_h1"), F.xxhash64(F.lit(2), *content).alias("_h2"), F.lit(sign).alias("_sign"))
    keys = [f"_k{i}" for i in range(len(key))]
    was, now = F.col("_sign") < 0, F.col("_sign") > 0
    # equal rows first become one, so that a key's list holds distinct contents only
    # (equal contents have equal states: as a key the state needs no minimum of strings, which would sort the rows)
    rows = side(before, -1).unionByName(side(after, 1)).groupBy(*keys, "_state", "_h1", "_h2").agg(
        F.count_if(was).alias("_was"), F.count_if(now).alias("_now"))
    states = lambda n: F.array_join(F.sort_array(F.collect_set(F.when(F.col(n) > 0, F.coalesce("_state", F.lit("")))))  , ",")
    per = rows.groupBy(*keys).agg(
        F.sum("_was").alias("n_before"), F.sum("_now").alias("n_after"), F.bool_or(F.col("_was") != F.col("_now")).alias("_differs"),
        states("_was").alias(f"{state}_before"), states("_now").alias(f"{state}_after"))
    kind = (F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "closed")
            .when(F.col(f"{state}_before") != F.col(f"{state}_after"), "status").otherwise("details"))
    return per.where("_differs").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key)], kind.alias("kind"), "n_before", "n_after",
                                        f"{state}_before", f"{state}_after")


def change_counts(changes: DataFrame) -> DataFrame:
    """Keys per kind of change."""
    return changes.groupBy("kind").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
