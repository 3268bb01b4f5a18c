"""File readers.

``read_many`` handles the extract layout of the original inputs: many CSV
files, each with a few preamble lines before its own header.  Files are read
as lines, so a large file is split over tasks; the preamble sits in a file's
first block, where lines keep their order, and is dropped there.  Every file's
header is read by itself and columns are matched by name.  A quoted field may
hold separators and doubled quotes; with ``multiline=True`` also line breaks
(see ``records``).  Without it a line with an odd number of quotes raises an error.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import records
from .types import apply_types, infer_types

SOURCE_FILE = "source_file"
NULL_TOKENS = ("", "NA")   # fields read as missing, after trimming
QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
BROADCAST_FILES = 100_000  # beyond this many files their headers join by shuffle


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One CSV with a header; types from ``schema``, else inferred (one more pass)."""
    r = spark.read.options(header=True, mode="PERMISSIVE", nullValue="NA", **QUOTING)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def period_paths(directory: str, closed_subdir: str = "complete_years") -> list[str]:
    """The closed-period folder and the current folder, read as one input (files only)."""
    return [f"{directory}/{closed_subdir}/*.csv", f"{directory}/*.csv"]


def _lines(spark: SparkSession, paths: Sequence[str], line_sep: str | None = None) -> DataFrame:
    """(value, file, block, in_first, at): ``at`` counts up by one from line to line of a file's block."""
    return spark.read.text(list(paths), lineSep=line_sep).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        (F.col("_metadata.file_block_start") == 0).alias("_in_first"), F.monotonically_increasing_id().alias("_at"))


def _headers(lines: DataFrame, skip: int) -> DataFrame:
    """(file, first, header): a file's first line number and its header line."""
    first = lines.where("_in_first").groupBy("_file").agg(F.min("_at").alias("_first"))
    first = first.select(F.col("_file").alias("_hf"), "_first")
    return lines.where("_in_first").join(
        first, (F.col("_file") == F.col("_hf")) & (F.col("_at") == F.col("_first") + skip)).select(
        "_hf", "_first", F.col("value").alias("_header"))


def _names(header: str, sep: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([header.strip("\r\ufeff")], delimiter=sep))]


def read_many(spark: SparkSession, paths: Sequence[str], skip: int = 0, dedupe: bool = False,
              drop_rows_after_header: int = 0, sep: str = ",", keep_source: bool = True,
              null_tokens: Sequence[str] = NULL_TOKENS, multiline: bool = False, types: str = "text") -> DataFrame:
    """Rows of CSV files that start with ``skip`` preamble lines, matched by column name.

    Columns come in the order of the first file (by path); a file whose set of
    names differs raises ``ValueError``.  Fields are trimmed, and those equal
    to one of ``null_tokens`` are null.  ``drop_rows_after_header`` drops that
    many lines right after each header (a description row, S7).  ``dedupe``
    removes whole-row duplicates across files (S3; the source file column is
    excluded from the comparison).  ``multiline``: quoted fields may hold line
    breaks (files with lines that end in LF or CRLF); preamble and header are
    single lines.  ``types="infer"`` gives every column the least type that all
    files' values have (``types.infer_types``: one more pass); else all are text.
    """
    if types not in ("text", "infer"):
        raise ValueError("types is 'text' or 'infer'")
    lines = _lines(spark, paths, "\n" if multiline else None)
    heads = _headers(lines, skip).checkpoint(eager=True)
    kinds = [r["_header"] for r in heads.groupBy("_header").agg(F.min("_hf").alias("f")).orderBy("f").collect()]
    if not kinds:
        raise ValueError(f"no header line in {list(paths)}")
    cols = _names(kinds[0], sep)
    for h in kinds:
        if sorted(_names(h, sep)) != sorted(cols):
            raise ValueError(f"column names differ: {sorted(_names(h, sep))} and {sorted(cols)}")
        if h.count('"') % 2:
            raise ValueError(f"a header line with an odd number of quotes: {h}")
    n = heads.count()
    x = lines.join(F.broadcast(heads) if n <= BROADCAST_FILES else heads, F.col("_file") == F.col("_hf"), "left")
    # a file of preamble lines alone has no rows; lines beyond a first block that lacks the header are an error
    x = x.where(F.when(F.col("_hf").isNull() & ~F.col("_in_first"), F.raise_error(F.concat(
        F.lit("preamble and header do not fit the first split of "), F.col("_file"))).cast("boolean")).otherwise(F.col("_hf").isNotNull()))
    x = x.where(~(F.col("_in_first") & (F.col("_at") <= F.col("_first") + skip + drop_rows_after_header)))
    if multiline:
        x = records.records(x.select("_file", "_block", "_at", "value"), heads.select(F.col("_hf").alias("_file"), "_header"),
                            broadcast_rows=BROADCAST_FILES)
        x = x.withColumn("value", F.regexp_replace("value", "\r\\z", ""))
    else:
        x = x.withColumn("value", F.when(records.quotes(F.col("value")) % 2 == 0, F.col("value")).otherwise(F.raise_error(F.concat(
            F.lit("a quoted field holds a line break, read it with multiline=True: "), F.col("_file"), F.lit(": "), F.left("value", F.lit(200))))))
    x = x.where(F.length("value") > 0)
    parts = []
    for h in kinds:  # files with one header are parsed together: usually one kind
        names = _names(h, sep)
        ddl = ", ".join(f"`c{cols.index(c)}` STRING" for c in names)
        r = x.where(F.col("_header") == F.lit(h)) if len(kinds) > 1 else x
        r = r.select(F.col("_file").alias(SOURCE_FILE), F.from_csv("value", ddl, {"sep": sep, **QUOTING}).alias("r"))
        clean = lambda c: F.when(~F.trim(c).isin(list(null_tokens)), F.trim(c))
        parts.append(r.select(*[clean(F.col(f"r.c{i}")).alias(c) for i, c in enumerate(cols)], SOURCE_FILE))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out if keep_source else out.drop(SOURCE_FILE)
    if types == "infer":
        out = apply_types(out, infer_types(out, cols))
    if dedupe:
        out = out.dropDuplicates(cols) if keep_source else out.distinct()
    return out


def load_audit(df: DataFrame) -> DataFrame:
    """Rows loaded per source file."""
    return df.groupBy(SOURCE_FILE).agg(F.count(F.lit(1)).alias("rows"))


def write_with_preamble(df: DataFrame, path: str, preamble: Sequence[str], file_key: Column | None = None,
                        sep: str = ",") -> str:
    """Write ``df`` as CSV text files that start with ``preamble`` lines and a header.

    The layout ``read_many`` reads (used to round-trip extracts in tests and
    in the ``services_via_files`` query).  ``file_key`` splits rows into
    files (one file per key, under ``path/_file=<key>/``); choose it so that
    no key is unbounded.  Every file gets its own preamble and header; lines
    are ordered inside each file by a sequence number.  Returns a glob of the
    written files.
    """
    cols = df.columns
    header = sep.join('"' + c.replace('"', '""') + '"' if (sep in c or '"' in c) else c for c in cols)
    key = file_key if file_key is not None else F.lit("part")
    data = df.select(key.cast("string").alias("_file"), F.lit(len(preamble) + 1).alias("_seq"),
                     F.to_csv(F.struct(*[F.col(f"`{c}`") for c in cols]),
                              {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("_line"))
    heads = (data.select("_file").distinct()
             .select("_file", F.posexplode(F.array(*[F.lit(x) for x in [*preamble, header]])).alias("_seq", "_line")))
    lines = heads.unionByName(data.select("_file", "_seq", "_line"))
    (lines.repartition("_file").sortWithinPartitions("_file", "_seq")
     .select("_file", "_line").write.mode("overwrite").partitionBy("_file").text(path))
    return f"{path}/*/*.txt"
