"""Records of CSV files whose quoted fields hold line breaks, read in splits.

A line break belongs to a field when an odd number of quotes stands before it in
its file.  A split does not know that number, so it is found in two passes:

1. Every split counts its quotes (an aggregate with one row per split); the parity
   at a split's start is the sum over the splits before it in its file.
2. Every split cuts its lines into records, knowing the parity it starts with.
   What it holds of a record that began before it, or goes on after it, are
   fragments: two per split at most, which are put together by (file, split where
   the record begins) and joined in order.

Only fragments are shuffled.  A file whose quotes are not balanced, and a record
longer than ``max_chars``, raise an error: no record is cut at a wrong place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_RECORD_CHARS = 1_000_000
COMPLETE, END, MIDDLE, BEGIN = 0, 1, 2, 3      # a whole record, or a fragment of one
PIECES = "_file string, _block long, _kind int, _header string, value string"


def quotes(c: Column, quote: str = '"') -> Column:
    """The number of quotes in a text."""
    return F.length(c) - F.length(F.replace(c, F.lit(quote), F.lit("")))


def start_parities(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(file, block, odd) of every split: whether an odd number of quotes stands before it in its file.

    Raises ``ValueError`` for a file with an odd number in all.  The window runs
    over one row per split.
    """
    per = lines.groupBy("_file", "_block").agg((F.sum(quotes(F.col("value"), quote)) % 2).alias("n"))
    before = Window.partitionBy("_file").orderBy("_block")
    out = per.select("_file", "_block", ((F.sum("n").over(before) - F.col("n")) % 2 == 1).alias("_odd"),
                     (F.sum("n").over(Window.partitionBy("_file")) % 2 == 1).alias("unbalanced")).checkpoint(eager=True)
    wrong = out.where("unbalanced").agg(F.min("_file"), F.count_distinct("_file")).first()
    if wrong[1]:
        raise ValueError(f"quotes are not balanced in {wrong[1]} file(s), the first is {wrong[0]}")
    return out.drop("unbalanced")


def _pieces(max_chars: int, quote: str):
    """Lines of splits, in order, as whole records and fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, size, odd, first = None, [], 0, False, False
        out = {k: [] for k in ("_file", "_block", "_kind", "_header", "value")}

        def put(kind: int) -> None:
            for k, v in zip(out, (*at[:2], kind, at[2], "\n".join(kept))):
                out[k].append(v)
            kept.clear()

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()))], names=list(out))
            for v in out.values():
                v.clear()
            return b

        for b in batches:
            n = pc.count_substring(b.column("value"), quote).to_pylist()
            for line, q, *where, starts_odd in zip(b.column("value").to_pylist(), n, b.column("_file").to_pylist(), b.column("_block").to_pylist(),
                                                  b.column("_header").to_pylist(), b.column("_odd").to_pylist()):
                if at is None or where[:2] != at[:2]:
                    if kept:
                        put(MIDDLE if first else BEGIN)
                    at, size, odd, first = where, 0, starts_odd, starts_odd
                kept.append(line)
                size += len(line) + 1
                odd ^= bool(q % 2)
                if size > max_chars:
                    raise ValueError(f"a record of more than {max_chars} characters in {at[0]}, at a split from byte {at[1]}")
                if not odd:
                    put(END if first else COMPLETE)
                    size, first = 0, False
            if out["value"]:
                yield batch()
        if kept:
            put(MIDDLE if first else BEGIN)
        if out["value"]:
            yield batch()

    return run


def records(lines: DataFrame, header_of: DataFrame, max_chars: int = MAX_RECORD_CHARS, quote: str = '"',
            broadcast_rows: int = 100_000) -> DataFrame:
    """(file, header, value): the records of ``lines`` (_file, _block, _at, value), with each file's ``_header``.

    ``lines`` holds no preamble.  Splits come with their start parity by a
    broadcast of one row per split while these are few; with more, lines are
    shuffled by split and sorted instead.
    """
    parity = start_parities(lines, quote)
    few = parity.count() <= broadcast_rows
    starts = parity.join(F.broadcast(header_of) if few else header_of, "_file").withColumnsRenamed({"_file": "_f", "_block": "_b"})
    d = lines.join(F.broadcast(starts) if few else starts, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    if not few:
        d = d.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_at")
    d = d.select("value", "_file", "_block", "_header", "_odd").mapInArrow(_pieces(max_chars, quote), PIECES)
    whole = d.where(F.col("_kind") == COMPLETE).select("_file", "_header", "value")
    parts = d.where(F.col("_kind") != COMPLETE)
    # a fragment belongs to the last split up to it in which a record begins and does not end
    begin = F.when(F.col("_kind") == BEGIN, F.col("_block"))
    earlier = Window.partitionBy("_file").orderBy("_block", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    keys = parts.select("_file", "_block", "_kind").withColumn(
        "_from", F.coalesce(begin, F.last(begin, ignorenulls=True).over(earlier)))
    parts = parts.join(keys, ["_file", "_block", "_kind"])
    size = F.sum(F.length("value") + 1)
    cut = parts.groupBy("_file", "_from").agg(
        F.min("_header").alias("_header"), size.alias("size"), F.sort_array(F.collect_list(F.struct("_block", "_kind", "value"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), "\n")
    text = F.when(F.col("size") <= max_chars, text).otherwise(
        F.raise_error(F.concat(F.lit(f"a record of more than {max_chars} characters in "), F.col("_file"))))
    return whole.unionByName(cut.select("_file", "_header", text.alias("value")))
