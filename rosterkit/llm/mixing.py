"""Operator 1: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a permuted stream of blocks of documents.  Its target (in
words) fixes how many full passes and how much of one more pass over that
stream the mix takes, hence its exact quota of block draws.  A binary tree over
the output shards splits the quota vector: a node with ``m`` shards draws its
left child's share from the multivariate hypergeometric law, so every leaf gets
an exact vector of quotas and every draw lands in exactly one shard.  The draws
of a source are dealt to the shards in stream order (disjoint ranges), and each
shard orders its rows by a seeded key.

Scale: the driver sees one row per source (never rows or blocks); blocks are
hash bins of about ``block_words`` words, so a source with a third of all rows
is many blocks; prefix sums over blocks run in two levels; documents are
shuffled once, on (source, block), and carry their text only if it is selected.

Defined cases: a null or empty text has size 0, is never drawn and keeps a row
with taken 0; a null source is a source of its own, ordered last; repeated rows
are separate rows; input columns that clash with output names come back as
``<name>_in``; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, keep_clear, n_words, small

WEIGHTS = (5.0, 2.0, 1.0)   # by source in code point order, repeating
SHARE = 1.5                 # words to take, as a share of all words
MAX_REPEAT = 2              # no source or document is taken more often
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 22
SEED = 20240607
SUPER = 1024                # blocks per super block of the prefix sums
OUT = ["size", "source_size", "target", "taken", "draws"]


def fill_targets(sizes: list[int], weights: list[float], total: float, max_repeat: float) -> list[float]:
    """Share ``total`` by weight; a target stops at ``max_repeat`` sizes and its excess is shared again."""
    target = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w >= max_repeat * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in full:
            target[i] = float(max_repeat * sizes[i])
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def split_node(lo: int, hi: int, quota: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """The middle of the shards ``lo..hi`` and the left child's quotas."""
    mid = (lo + hi) // 2
    rng = np.random.default_rng([seed, lo, hi])
    n_left = int(quota.sum()) * (mid - lo) // (hi - lo)
    return mid, rng.multivariate_hypergeometric(quota, n_left, method="marginals")


def leaves(lo: int, hi: int, quota: np.ndarray, first: np.ndarray, seed: int):
    """Yield ``(shard, quotas, first draw of each source)`` of a subtree, left to right."""
    stack = [(lo, hi, quota, first)]
    while stack:
        lo, hi, quota, first = stack.pop()
        if hi - lo == 1:
            yield lo, quota, first
            continue
        mid, left = split_node(lo, hi, quota, seed)
        stack += [(mid, hi, quota - left, first + left), (lo, mid, left, first)]


def shard_quotas(spark, quota: list[int], n_shards: int, seed: int, subtrees: int = 64) -> DataFrame:
    """(shard, si, first, n): the draws ``first .. first+n-1`` of source ``si`` go to ``shard``.

    The top of the tree is split on the driver until there are ``subtrees`` nodes; tasks split the rest.
    """
    nodes = [(0, n_shards, np.asarray(quota, dtype=np.int64), np.zeros(len(quota), dtype=np.int64))]
    while len(nodes) < min(subtrees, n_shards):
        i = max(range(len(nodes)), key=lambda j: nodes[j][1] - nodes[j][0])
        lo, hi, q, f = nodes.pop(i)
        mid, left = split_node(lo, hi, q, seed)
        nodes[i:i] = [(lo, mid, left, f), (mid, hi, q - left, f + left)]
    rows = [(lo, hi, q.tolist(), f.tolist()) for lo, hi, q, f in nodes]

    def grow(batches):
        for pdf in batches:
            for lo, hi, q, f in pdf.itertuples(index=False):
                for shard, n, first in leaves(lo, hi, np.asarray(q, dtype=np.int64), np.asarray(f, dtype=np.int64), seed):
                    si = np.flatnonzero(n)
                    yield pd.DataFrame({"shard": np.full(len(si), shard), "si": si, "first": first[si], "n": n[si]})

    df = spark.createDataFrame(rows, "lo long, hi long, q array<long>, f array<long>")
    return df.repartition(min(len(rows), 64)).mapInPandas(grow, "shard long, si long, first long, n long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Documents with ``size, source_size, target, taken`` and ``draws``: array of (pass, shard, words).

    ``words`` is how many of the document's first words a draw takes: all of
    them but for the one document per source at which the target is reached.
    """
    spark = docs.sparkSession
    d = keep_clear(docs, [*OUT, "_si", "_p", "_h"])
    d = d.withColumn("size", n_words()).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    # one row per source: the mixture's own parameter table
    rows = d.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"] or 0) for r in rows]
    target = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share * sum(sizes), max_repeat)
    take = [min(round(t), max_repeat * s) for t, s in zip(target, sizes)]
    full = [t // s if s else 0 for t, s in zip(take, sizes)]
    n_blocks = [max(1, math.ceil(s / block_words)) for s in sizes]
    rng = np.random.default_rng(seed)
    step = []
    for n in n_blocks:
        a = int(rng.integers(1, n + 1))
        while math.gcd(a, n) != 1:
            a += 1
        step.append((a, int(rng.integers(0, n))))
    src = small(spark.createDataFrame(
        [(r["source"], i, n_blocks[i], *step[i], sizes[i], float(target[i]), full[i], take[i] - full[i] * sizes[i])
         for i, r in enumerate(rows)],
        "_source string, _si long, _nb long, _a long, _c long, source_size long, target double, _full long, _rem long"),
        len(rows))
    d = d.join(src, d["source"].eqNullSafe(src["_source"]))
    d = d.withColumn("_p", F.pmod(F.pmod("_h", "_nb") * F.col("_a") + F.col("_c"), F.col("_nb")))

    # blocks with their place in the source's stream (two-level prefix sums)
    blocks = (d.groupBy("_si", "_p", "_nb", "_full", "_rem").agg(F.sum("size").alias("_words"))
              .withColumn("_sb", F.floor(F.col("_p") / SUPER)))
    blocks = cut(blocks, "blocks")
    supers = blocks.groupBy("_si", "_sb").agg(F.sum("_words").alias("_sw"))
    supers = supers.withColumn("_base", F.sum("_sw").over(Window.partitionBy("_si").orderBy("_sb")) - F.col("_sw")).drop("_sw")
    inside = Window.partitionBy("_si", "_sb").orderBy("_p")
    blocks = (blocks.withColumn("_in", F.sum("_words").over(inside) - F.col("_words")).join(supers, ["_si", "_sb"])
              .withColumn("_left", F.col("_rem") - F.col("_base") - F.col("_in")))
    passes = F.when(F.col("_left") > 0, F.col("_full") + 1).otherwise(F.col("_full"))
    units = (blocks.where((passes > 0) & (F.col("_words") > 0))
             .select("_si", "_p", "_nb", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("_pass"),
                     "_full", "_left", "_words")
             .select("_si", "_p", (F.col("_pass") * F.col("_nb") + F.col("_p")).alias("_key"), "_pass",
                     F.when(F.col("_pass") < F.col("_full"), F.col("_words"))
                     .otherwise(F.least("_words", "_left")).alias("_limit")))
    # rank of a draw in its source's stream: two levels again, the hot source is many groups
    units = units.withColumn("_g", F.floor(F.col("_key") / SUPER))
    per = units.groupBy("_si", "_g").agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_before", F.sum("_n").over(Window.partitionBy("_si").orderBy("_g")) - F.col("_n")).drop("_n")
    units = (units.withColumn("_r", F.row_number().over(Window.partitionBy("_si", "_g").orderBy("_key")))
             .join(per, ["_si", "_g"]).withColumn("_r", F.col("_r") - 1 + F.col("_before")))
    units = cut(units.select("_si", "_p", "_pass", "_limit", "_r"), "units")
    drawn = {r["_si"]: int(r["n"]) for r in units.groupBy("_si").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = [drawn.get(i, 0) for i in range(len(rows))]
    n_shards = max(1, min(math.ceil(sum(take) / shard_words), sum(quota)))
    if sum(quota):
        q = shard_quotas(spark, quota, n_shards, seed)
        q = q.select(F.col("shard"), F.col("si").alias("_si"),
                     F.explode(F.expr("sequence(first, first + n - 1)")).alias("_r"))
        units = units.join(q, ["_si", "_r"])
    else:
        units = units.withColumn("shard", F.lit(0).cast("long"))
    draws = units.groupBy("_si", "_p").agg(F.sort_array(F.collect_list(F.struct(
        F.col("_pass").alias("pass"), "shard", F.col("_limit").alias("words")))).alias("_draws"))

    order = Window.partitionBy("_si", "_p").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    d = d.join(draws, ["_si", "_p"], "left")
    here = F.filter(F.transform(F.coalesce("_draws", F.expr("cast(array() as array<struct<pass:bigint,shard:bigint,words:bigint>>)")),
                                lambda u: F.struct(u["pass"].alias("pass"), u["shard"].alias("shard"),
                                                   F.least("size", u["words"] - F.col("_start")).alias("words"))),
                    lambda u: u["words"] > 0)
    d = d.withColumn("draws", here)
    d = d.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda s, u: s + u["words"]))
    keep = [c for c in keep_clear(docs, [*OUT, "_si", "_p", "_h"]).columns]
    return d.select(*[F.col(f"`{c}`") for c in keep], *OUT)


def shards(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per draw: the input columns, ``shard``, ``pass``, ``words`` and ``position`` (a seeded sort key)."""
    x = mixed.withColumn("_u", F.explode("draws"))
    cols = [c for c in mixed.columns if c != "draws"]
    return x.select(*[F.col(f"`{c}`") for c in cols], F.col("_u.shard").alias("shard"), F.col("_u.pass").alias("pass"),
                    F.col("_u.words").alias("words"),
                    F.xxhash64(F.lit(seed), "_u.shard", "_u.pass", "doc_id").alias("position"))


def in_shards(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """``shards`` ranged by (shard, position) and sorted: a shard's rows are together, shuffled inside."""
    return shards(mixed, seed).repartitionByRange("shard", "position").sortWithinPartitions("shard", "position")


def write_shards(mixed: DataFrame, path: str, seed: int = SEED) -> str:
    """Write the mix, one folder per shard, in the order of ``in_shards``."""
    in_shards(mixed, seed).write.mode("overwrite").partitionBy("shard").parquet(path)
    return path
