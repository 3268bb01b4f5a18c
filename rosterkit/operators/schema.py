"""Schema-level operators.

They work on the DataFrame schema (a driver-side list of names) and return a
new lazy DataFrame; none of them touches rows on the driver.  The one
exception is ``drop_all_null`` (C4), whose output schema depends on the data:
it runs one aggregate action that returns a single row of counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- header cleaning (C1, C2, C3) -------------------------------------------

# Unicode punctuation, the class removed by header style 'strip'.
_PUNCT = re.compile(r"[^\w\s]|_", re.UNICODE)


def clean_name(name: str, style: str) -> str:
    """Clean one header.

    ``strip``: delete all punctuation (``_`` and ``-`` included), then blank -> ``_``.
    ``underscore``: delete ``:``; blank or ``-`` -> ``_``.
    ``lower``: blank, ``-`` or ``:`` -> ``_``; lower case.
    """
    if style == "strip":
        return re.sub(r" ", "_", _PUNCT.sub("", name))
    if style == "underscore":
        return re.sub(r" |-", "_", name.replace(":", ""))
    if style == "lower":
        return re.sub(r" |-|:", "_", name).lower()
    raise ValueError(f"unknown header style {style!r}")


def clean_names(df: DataFrame, style: str) -> DataFrame:
    return df.toDF(*[clean_name(c, style) for c in df.columns])


# -- column selection helpers -------------------------------------------------

def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns whose values are all NULL (one aggregate action)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if counts[f"c{i}"] > 0]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def drop_matching(df: DataFrame, prefix: str | None = None, suffix: str | None = None,
                  names: Sequence[str] = ()) -> DataFrame:
    """Drop columns by case-insensitive prefix / suffix, or by name."""
    def hit(c: str) -> bool:
        lc = c.lower()
        return ((prefix is not None and lc.startswith(prefix.lower()))
                or (suffix is not None and lc.endswith(suffix.lower()))
                or c in names)
    return df.drop(*[c for c in df.columns if hit(c)])


def col_range(df: DataFrame, first: str, last: str, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the positional column range ``first`` .. ``last`` (inclusive)."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    return [c for c in cols[i: j + 1] if c not in exclude]


def reorder(df: DataFrame, named: Sequence[str] = (), suffixes: Sequence[str] = (),
            prefixes: Sequence[str] = ()) -> DataFrame:
    """Named columns, then each suffix group, then each prefix group, then the rest.

    First match wins and the original order is kept inside each group.
    """
    out: list[str] = []

    def take(pred: Callable[[str], bool]):
        for c in df.columns:
            if c not in out and pred(c):
                out.append(c)
    for n in named:
        take(lambda c, n=n: c == n)
    for s in suffixes:
        take(lambda c, s=s: c.endswith(s))
    for p in prefixes:
        take(lambda c, p=p: c.startswith(p))
    take(lambda c: True)
    return df.select(*out)


def select_prefixed(df: DataFrame, prefix: str) -> list[str]:
    """The column names starting with ``prefix`` in schema order."""
    return [c for c in df.columns if c.startswith(prefix)]


def map_cols(df: DataFrame, cols: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    """C11: apply one column function to a set of columns."""
    return df.withColumns({c: f(F.col(f"`{c}`")) for c in cols})


def cols_of_type(df: DataFrame, type_name: str) -> list[str]:
    """The columns of a given simple type, in schema order."""
    return [fld.name for fld in df.schema.fields if fld.dataType.simpleString() == type_name]


def map_cols_of_type(df: DataFrame, type_name: str, f: Callable[[Column], Column]) -> DataFrame:
    """Apply one column function to every column of a given simple type."""
    return map_cols(df, cols_of_type(df, type_name), f)


def recode(c, mapping: Mapping[str, str]) -> Column:
    """Replace values found in ``mapping``; other values unchanged.

    A literal map lookup (no join); a missing key returns NULL, hence coalesce.
    """
    x = F.col(c) if isinstance(c, str) else c
    if not mapping:
        return x
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(m, x), x)


def null_tokens(df: DataFrame, tokens: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """String values equal to one of ``tokens`` become NULL."""
    if cols is None:
        return map_cols_of_type(df, "string", lambda c: F.when(~c.isin(list(tokens)), c))
    return map_cols(df, cols, lambda c: F.when(~c.isin(list(tokens)), c))


def row_sum(cols: Sequence[str]) -> Column:
    """Row-wise sum across columns."""
    return reduce(add, [F.col(f"`{c}`") for c in cols])


# -- reshape (R1, R2) ---------------------------------------------------------

def unpivot_flags(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                  name: str = "field", value: str = "val") -> DataFrame:
    """Long form of flag columns; NULL values are kept as rows."""
    return df.unpivot(list(ids), list(values), name, value)


def pivot_counts(df: DataFrame, row: str, col: str, value: str, col_values: Sequence[str] | None = None,
                 fill: int = 0) -> DataFrame:
    """R2: one column per value of ``col``; a missing cell is ``fill``.

    Pass ``col_values`` to fix the column set and skip Spark's extra job that
    discovers them.
    """
    g = df.groupBy(row)
    p = g.pivot(col, list(col_values)) if col_values is not None else g.pivot(col)
    out = p.agg(F.sum(value))
    # by back-quoted name: a value may hold a dot
    return out.select(F.col(f"`{row}`"), *[F.coalesce(F.col(f"`{c}`"), F.lit(fill)).alias(c) for c in out.columns if c != row])


def safe_name(s: str) -> str:
    """A lower-case identifier made from a data value (for pivoted headers)."""
    return re.sub(r"[^0-9a-z]+", "_", s.lower()).strip("_")


def unique_names(values: Sequence[str], prefix: str = "", taken: Sequence[str] = ()) -> list[str]:
    """One identifier per value: ``prefix + safe_name``, with ``_2``, ``_3`` ... where names would be equal."""
    used, out = set(taken), []
    for v in values:
        base = prefix + safe_name(v)
        name, k = base, 2
        while name in used:
            name, k = f"{base}_{k}", k + 1
        used.add(name)
        out.append(name)
    return out
