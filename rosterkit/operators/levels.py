"""Ordered level encoding: text columns as codes into a dictionary of levels.

Codes follow the sort order of the values (binary, ascending) and are dense from 1.
The dictionary is a table: its values are range-partitioned and numbered by the
count of the values before each partition, so it may be of any size and never
passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import with_row_number
from .schema import cols_of_type

LEVELS = ["column", "code", "level"]


def _number(values: DataFrame) -> DataFrame:
    """(column, code, level) from distinct (column, level): codes from 1 in each column, in order."""
    n = with_row_number(values.select("column", "level"), [F.col("column"), F.col("level")], "_row")
    first = n.groupBy("column").agg(F.min("_row").alias("_first"))   # one row per column
    return n.join(F.broadcast(first), "column").select("column", (F.col("_row") - F.col("_first") + 1).alias("code"), "level")


def levels_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The dictionary (column, code, level) of some text columns; NULL is no level."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("level")) for c in cols]))
    values = df.select(pairs.alias("p")).select("p.column", "p.level").where(F.col("level").isNotNull())
    return _number(values.distinct())


def encode_levels(df: DataFrame, cols: Sequence[str] | None = None, levels: DataFrame | None = None,
                  suffix: str = "_code") -> tuple[DataFrame, DataFrame]:
    """The rows with ``<column>_code`` in place of each column, and the dictionary.

    ``cols``: every text column when left out.  With ``levels`` given, values it lacks
    become NULL.  A NULL value has a NULL code.  Codes come by one join per column,
    which Spark turns into a broadcast where the measured dictionary is small.
    """
    cols = list(cols) if cols is not None else cols_of_type(df, "string")
    levels = levels_of(df, cols) if levels is None else levels
    out = df
    for i, c in enumerate(cols):
        own = levels.where(F.col("column") == c).select(F.col("code").alias(f"_code{i}"), F.col("level").alias(f"_level{i}"))
        out = out.join(own, F.col(f"`{c}`") == F.col(f"_level{i}"), "left").drop(f"_level{i}")
    keep = [F.col(f"_code{cols.index(c)}").alias(c + suffix) if c in cols else F.col(f"`{c}`") for c in df.columns]
    return out.select(*keep), levels


def drop_levels(levels: DataFrame, encoded: DataFrame, code_of: dict[str, str]) -> DataFrame:
    """C17: the levels that ``encoded`` still uses, with new dense codes: (column, old_code, code, level).

    ``code_of``: dictionary column -> code column of ``encoded``.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{k}`").alias("code")) for c, k in code_of.items()]))
    used = encoded.select(pairs.alias("p")).select("p.column", "p.code").where(F.col("code").isNotNull()).distinct()
    kept = levels.join(used, ["column", "code"], "left_semi").withColumnRenamed("code", "old_code").checkpoint(eager=True)
    return _number(kept).join(kept, ["column", "level"]).select("column", "old_code", "code", "level")


def recode_levels(encoded: DataFrame, dropped: DataFrame, code_of: dict[str, str]) -> DataFrame:
    """``encoded`` with the new codes of ``drop_levels``."""
    out = encoded
    for i, (c, k) in enumerate(code_of.items()):
        new = dropped.where(F.col("column") == c).select(F.col("old_code").alias(f"_old{i}"), F.col("code").alias(f"_new{i}"))
        out = out.join(new, F.col(f"`{k}`") == F.col(f"_old{i}"), "left").drop(f"_old{i}")
    names = {k: i for i, k in enumerate(code_of.values())}
    return out.select(*[F.col(f"_new{names[k]}").alias(k) if k in names else F.col(f"`{k}`") for k in encoded.columns])
