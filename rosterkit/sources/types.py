"""Column types inferred from the text of all files.

Types form a lattice: a column without values is below every type, integer is
below double, text is above all, and two others only meet in text.  For every
column one aggregate keeps which types hold all values seen so far; such facts of
any two parts of the data merge by AND, so one pass with map-side combine over all
files settles every column, and the last file can still widen a type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spellings of logical values, and what integers, doubles and dates look like.
LOGICAL = ("T", "F", "TRUE", "FALSE", "true", "false")
INTEGER = r"^[+-]?(0|[1-9][0-9]*)$"
DOUBLE = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}$"
# from the most special to the most general
ORDER = ("logical", "integer", "double", "date", "text")
SPARK_TYPE = {"logical": "boolean", "integer": "bigint", "double": "double", "date": "date", "text": "string"}


def _date(c: Column) -> Column:
    """A calendar day, ``Y-M-D`` or ``Y/M/D``; other text is null."""
    return F.when(c.rlike(DATE), F.try_to_date(F.replace(c, F.lit("/"), F.lit("-")), "yyyy-M-d"))


def tests(c: Column) -> dict[str, Column]:
    """For every type but text, whether a value has it; null where there is no value.  Numbers with a leading zero are codes, that is text."""
    has = {
        "logical": c.isin(list(LOGICAL)),
        "integer": c.rlike(INTEGER) & c.try_cast("bigint").isNotNull(),
        "double": c.rlike(DOUBLE),
        "date": _date(c).isNotNull(),
    }
    return {kind: F.when(c.isNotNull(), test) for kind, test in has.items()}


def type_facts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: per column ``i`` the number of values ``n_i`` and, per type, whether all values have it."""
    aggs = []
    for i, name in enumerate(cols):
        c = F.col(f"`{name}`")
        aggs.append(F.count(c).alias(f"n_{i}"))
        aggs += [F.bool_and(test).alias(f"{kind}_{i}") for kind, test in tests(c).items()]
    return df.agg(*aggs)


def merge_types(a: str, b: str) -> str:
    """The least type above both ("empty" is below all)."""
    if a == b or b == "empty":
        return a
    if a == "empty":
        return b
    return "double" if {a, b} == {"integer", "double"} else "text"


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, str]:
    """The type of every text column: ``empty`` without values, else the most special one that all values have."""
    cols = list(cols if cols is not None else [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
    facts = type_facts(df, cols).first()   # one row, its width bounded by the schema
    out = {}
    for i, name in enumerate(cols):
        if not facts[f"n_{i}"]:
            out[name] = "empty"
        else:
            out[name] = next((kind for kind in ORDER[:-1] if facts[f"{kind}_{i}"]), "text")
    return out


def inferred_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: its name, its inferred type and its number of values."""
    facts = type_facts(df, cols)
    rows = []
    for i, name in enumerate(cols):
        kind = F.when(F.col(f"n_{i}") == 0, F.lit("empty"))
        for k in ORDER[:-1]:
            kind = kind.when(F.col(f"{k}_{i}"), F.lit(k))
        rows.append(F.struct(F.lit(name).alias("column"), kind.otherwise(F.lit("text")).alias("type"), F.col(f"n_{i}").alias("n_values")))
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.column", "r.type", "r.n_values")


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to their inferred types; an empty column stays text."""
    def cast(name: str) -> Column:
        c, kind = F.col(f"`{name}`"), types.get(name, "text")
        if kind == "logical":
            return F.upper(F.left(c, F.lit(1))) == "T"
        if kind == "date":
            return _date(c)
        return c.cast(SPARK_TYPE[kind]) if kind in ("integer", "double") else c
    return df.select(*[cast(c).alias(c) for c in df.columns])
