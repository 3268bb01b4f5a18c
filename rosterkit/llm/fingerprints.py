"""Operator 10: document fingerprints by one-permutation MinHash (native DataFrame functions only).

A text's 5-word shingles (A-Z lower-cased; fewer words: the whole sequence is
one shingle) are hashed once; the top bits of a hash name one of 128 bins and
every bin keeps its least hash.  Empty bins are filled by densification: bin
``j`` probes the bins in an order of its own, fixed by a hash of ``j`` (an affine
walk that reaches every bin), and copies the first one that is not empty.  Only
the low 8 bits of each bin are stored, packed as 256 hex digits; the likeness
of two fingerprints is the share of equal bins, corrected for the 1/256 of bins
that agree by chance.

Scale: a fingerprint is made inside its row.  The next document in descending
doc_id is found with one shuffle of the rows into ranges of doc_id (sized by
row count) and a ``lead`` inside each range; the row after a range's last one
is read from a table with one row per range.

Defined cases: null text is empty and has the empty fingerprint, which is like
another empty one (1) and unlike any other (0); null ids follow all others,
ordered by a hash of the text, as do repeated ids among themselves; a table's
last document is followed by its first (a single row by itself); clashing
input columns come back as ``<name>_in``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, keep_clear, whole_text

BINS = 128
BIN_BITS = 7
LOW_BITS = 8
PROBES = 8             # steps of a walk tried one by one
SHINGLE = 5
RANGE_ROWS = 4096      # documents in one range of doc_id
MAX_RANGES = 1 << 16   # ranges only grow beyond this many


def probes(seed: int = 7) -> tuple[list[int], list[int]]:
    """For each bin ``j``: start ``a`` and odd step ``b`` of its walk ``a + t * b`` (mod BINS), which meets every bin."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, BINS, BINS).tolist(), (rng.integers(0, BINS // 2, BINS) * 2 + 1).tolist()


def plain_words(text: Column) -> Column:
    """Array of the words, A-Z lower-cased."""
    flat = F.translate(whole_text(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\f\r", "abcdefghijklmnopqrstuvwxyz     ")
    return F.array_remove(F.split(flat, " "), "")


def add_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add column ``name`` with the packed fingerprint of ``text`` (empty string: no word)."""
    a, b = probes()
    d = df.withColumn("_w", plain_words(text))
    d = d.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    pair = lambda x, y, gap: F.zip_with(  # noqa: E731  hashes of two arrays, the second ``gap`` places on
        F.slice(x, F.lit(1), F.size(y) - gap), F.slice(y, F.lit(gap + 1), F.size(y) - gap), lambda u, v: F.xxhash64(u, v))
    many = F.size("_h") >= SHINGLE
    d = d.withColumn("_2", F.when(many, pair(F.col("_h"), F.col("_h"), 1)))
    d = d.withColumn("_4", F.when(many, pair(F.col("_2"), F.col("_2"), 2)))
    d = d.withColumn("_s", F.when(many, pair(F.col("_4"), F.col("_h"), 4))
                     .when(F.size("_h") > 0, F.array(F.xxhash64(F.array_join("_w", " "))))
                     .otherwise(F.expr("cast(array() as array<bigint>)")))
    d = d.drop("_w", "_h", "_2", "_4").withColumn("_s", F.sort_array("_s"))
    h = F.col("_s")
    bin_of = lambda x: (F.shiftright(x, 64 - BIN_BITS) + BINS // 2).cast("int")  # noqa: E731  0..127 in sorted order
    # the first hash of each bin in sorted order is the bin's least
    d = d.withColumn("_f", F.filter("_s", lambda x, i: F.coalesce(
        F.shiftright(F.when(i > 0, F.get(h, i - 1)), 64 - BIN_BITS) != F.shiftright(x, 64 - BIN_BITS), F.lit(True))))
    d = d.withColumn("_f", F.transform("_f", lambda x: F.struct(bin_of(x).alias("b"), x.alias("x"))))
    f = F.col("_f")
    holes = F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), F.transform(f, lambda x: x["b"]))
    none = F.lit(None).cast("long")
    # all bins in order, empty ones null
    d = d.withColumn("_d", F.when((F.size(f) > 0) & (F.size(f) < BINS), F.sort_array(F.concat(
        f, F.transform(holes, lambda j: F.struct(j.alias("b"), none.alias("x")))))).otherwise(f))
    al, bl = F.array(*map(F.lit, a)), F.array(*map(F.lit, b))
    inv = F.array(*[F.lit(pow(x, -1, BINS)) for x in b])
    at = F.col("_d")
    probe = lambda j, t: F.get(at, (F.get(al, j) + t * F.get(bl, j)).bitwiseAND(F.lit(BINS - 1)))["x"]
    # beyond PROBES steps: the bin that the walk meets first, by the number of steps to it
    far = lambda j: F.array_min(F.transform(f, lambda x: F.struct(
        ((x["b"] - F.get(al, j)) * F.get(inv, j)).bitwiseAND(F.lit(BINS - 1)).alias("t"), x["x"].alias("x"))))["x"]
    value = lambda y: F.coalesce(y["x"], *[probe(y["b"], t) for t in range(PROBES)], far(y["b"]))
    # the stored bits mix in the bin, so copies of one hash agree with another text's by chance bin by bin
    low = lambda y: F.hex(F.xxhash64(value(y), y["b"]).bitwiseAND(F.lit((1 << LOW_BITS) - 1)))
    d = d.withColumn(name, F.array_join(F.transform("_d", lambda y: F.lpad(low(y), 2, "0")), ""))
    return d.drop("_s", "_f", "_d")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1, corrected for chance agreement."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)),
                           lambda i: F.substring(a, 2 * i + 1, F.lit(2)) == F.substring(b, 2 * i + 1, F.lit(2))))
    chance = 1.0 / (1 << LOW_BITS)
    j = (same / BINS - chance) / (1 - chance)
    return (F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), j))))


def with_next(docs: DataFrame, derive, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the next document in descending doc_id (last: the first).

    ``derive`` adds columns to the documents (from ``text``); the result has them, ``next_text`` and
    ``next_<column>`` of each added column.
    """
    d = derive(docs).withColumn("_t", F.xxhash64("text"))
    cols = ["text", *[c for c in d.columns if c not in docs.columns and c != "_t"]]
    rows = docs.count()
    n = max(1, min(math.ceil(rows / range_rows), MAX_RANGES))
    bounds = []
    if n > 1:
        bounds = docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile(
            "x", [i / n for i in range(1, n)], 1 / (8 * n))
    splits = [-math.inf, *(sorted(set(bounds)) or [0.0]), math.inf]   # a bucketizer needs two ranges or more
    d = d.withColumn("_x", F.col("doc_id").cast("double"))
    d = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(d)
    # null ids: ranges of their text hash, below all ids
    d = d.withColumn("_b", F.when(F.col("doc_id").isNotNull(), F.col("_b")).otherwise(
        F.shiftright("_t", 57) - F.lit(65)).cast("long")).drop("_x")
    down = [F.col("doc_id").desc_nulls_last(), F.col("_t").desc()]
    w = Window.partitionBy("_b").orderBy(*down)
    d = d.withColumns({f"_n_{c}": F.lead(F.struct(c), 1).over(w) for c in cols}).withColumn("_row", F.row_number().over(w))
    # the first row of every range, and the range that reads it: the one above (the lowest follows the highest)
    first = docs.withColumn("_t", F.xxhash64("text"))
    heads = derive(cut(_heads(first, splits), "range_heads"))
    order = Window.orderBy(F.col("_b").desc())
    nxt = heads.select("_b", F.coalesce(F.lead("_b").over(order), F.max("_b").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    edge = nxt.join(heads.withColumnRenamed("_b", "_to"), "_to").select(
        F.col("_b").alias("_eb"), *[F.struct(F.col(c)).alias(f"_e_{c}") for c in cols])
    d = d.join(edge, d["_b"] == edge["_eb"], "left")
    for c in cols:
        v = F.when(F.col(f"_n_{c}").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(f"_e_{c}"))
        d = d.withColumn(f"next_{c}", v[c])
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], *cols[1:], *[f"next_{c}" for c in cols])


def _heads(d: DataFrame, splits: list[float]) -> DataFrame:
    """The text of the first row (in descending order) of every range."""
    d = d.withColumn("_x", F.col("doc_id").cast("double"))
    d = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(d)
    d = d.withColumn("_b", F.when(F.col("doc_id").isNotNull(), F.col("_b")).otherwise(
        F.shiftright("_t", 57) - F.lit(65)).cast("long")).drop("_x")
    top = d.groupBy("_b").agg(F.max(F.struct("doc_id", "_t")).alias("_top"))
    top = top.select("_b", F.col("_top.doc_id").alias("_i"), F.col("_top._t").alias("_tt"))
    hit = d.join(F.broadcast(top.select(F.col("_b").alias("_tb"), "_i", "_tt")),  # at most MAX_RANGES + 128 rows
                 (F.col("_b") == F.col("_tb")) & F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("_t").eqNullSafe(F.col("_tt")))
    return hit.dropDuplicates(["_b"]).select("_b", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Add ``fingerprint`` to every document."""
    return add_fingerprint(keep_clear(docs, ["fingerprint"]), F.col("text"), "fingerprint")


def edited(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``fingerprint``, the next document's ``next_text`` and ``next_fingerprint``, and ``edited_text`` with its own.

    The edited text replaces the last third (floor) of the code points by the
    first as many of the next document.
    """
    out = ["fingerprint", "next_text", "next_fingerprint", "edited_text", "edited_fingerprint"]
    d = keep_clear(docs, out).withColumn("text", whole_text())
    d = with_next(d, lambda x: add_fingerprint(x, F.col("text"), "fingerprint"), range_rows)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    d = d.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), n - third),
                                             F.substring(F.col("next_text"), F.lit(1), third)))
    return add_fingerprint(d, F.col("edited_text"), "edited_fingerprint")
