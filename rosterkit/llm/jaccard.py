"""Operator 7: n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles.  Equal sets form one class
(links inside a class are certain), so only one row per class is joined.
Shingles are put in one global order, rare before frequent: a hash-chosen share
of the shingles is ordered by exact document frequency over the whole table,
the others follow by hash.  Two sets with enough overlap must share ``l`` of
their ``base + l - 1`` first shingles; every document takes the ``l`` with the
least estimated cost (rows to scan plus candidates to verify, from the
frequencies of its own prefix), and a pair must share the smaller ``l`` of the
two within the matching prefixes before it is verified on the full sets.

Links are found in two rounds.  Round 1 pairs every member of a shared prefix
shingle with the member whose shingles are most frequent on average (in a group
of near copies, the one closest to their common origin).  Round 2 takes all
pairs that round 1 left in different components and applies the multi-match
rule.  A pair inside one component needs no check: the component is the result.

The first prefixes only order a hash-chosen share of the shingles by frequency;
they settle which classes can have a partner at all.  The prefixes of these few
classes are then built again from their full sets, with every shingle ordered
by its frequency among them, so a copy's own edits come first and two copies
with many edits never meet.

Scale: frequencies travel as packed arrays between blocks and partitions of the
key space (``exchange``); shingles of one document only send nothing.  Prefix
entries, pairs and links are rows that Spark shuffles; full sets are rebuilt
only for classes that share a prefix shingle.  A prefix shingle whose members
are already in one component is dropped before round 2, so a large group of
near copies costs its members, not their pairs; members of one shingle that stay
in different components do meet pairwise (no index can exclude them).

Defined cases: null and empty texts have no shingle and no link; a text with
fewer words than a shingle is one shingle; repeated rows get the same class; a
row with a null id takes part and its component's id is the least id that is
not null (null if there is none); extra columns are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange, shingles
from .common import cut, tidy, tidy_group, whole_text

WORDS = 5            # words in a shingle
PERCENT = 80         # least similarity, in percent
LEVELS = 4           # the longest multi-match prefix needs this many shared shingles
BLOCK_CHARS = 4_000_000
PACKED = ("block long, doc_id array<long>, tkey array<long>, sig array<binary>, n array<int>, kept array<int>, "
          "chosen array<int>, tokens binary")
ENTRY = "token long, sig binary, n int, pos int, level int, score double"


def least_overlap(nx, ny, percent: int):
    """Shared shingles that two sets need: the least ``i`` with 100 * i >= percent * (nx + ny - i)."""
    return -(-(percent * (nx + ny)) // (100 + percent))


def pack(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per block: ids, set signatures and sizes, and each document's shingles that may enter its prefix."""
    part_of = 4 if percent >= 88 else 2   # one in so many shingles is ordered by frequency

    def run(batches):
        ids = exchange.block_ids()
        for b in batches:
            texts = b.column("text").to_pylist()
            start, size = 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                if size < BLOCK_CHARS and end < len(texts):
                    continue
                sig, n, kept, chosen, tokens = [], [], [], [], []
                for t in texts[start:end]:
                    s = shingles.shingle_set(t, words)
                    pick = (s & np.uint64(part_of - 1)) == 0
                    first, rest = s[pick], s[~pick]
                    need = len(s) - (percent * len(s) + 99) // 100 + LEVELS
                    rest = rest[:max(0, need - len(first))]
                    sig.append(shingles.signature(s))
                    n.append(len(s))
                    kept.append(len(first) + len(rest))
                    chosen.append(len(first))
                    tokens += [first, rest]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(ids)], pa.int64()), *[pa.array([x], pa.list_(k)) for x, k in (
                        (b.column("doc_id").slice(start, end - start).to_pylist(), pa.int64()),
                        (b.column("tkey").slice(start, end - start).to_pylist(), pa.int64()),
                        (sig, pa.binary()), (n, pa.int32()), (kept, pa.int32()), (chosen, pa.int32()))],
                     pa.array([np.concatenate(tokens).astype(exchange.U64).tobytes() if tokens else b""], pa.binary())],
                    names=["block", "doc_id", "tkey", "sig", "n", "kept", "chosen", "tokens"])
                start, size = end, 0

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return d.withColumn("tkey", F.xxhash64("text")).mapInArrow(tidy(run), PACKED)


def _chosen(tokens: np.ndarray, kept: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Mask of the tokens that are ordered by frequency."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(kept) - kept, kept)
    return place < np.repeat(chosen, kept)


def _requests(packed: DataFrame, n_parts: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                t = np.frombuffer(r["tokens"], exchange.U64)
                t = t[_chosen(t, np.array(r["kept"], dtype=np.int64), np.array(r["chosen"], dtype=np.int64))]
                if len(t):
                    keys, counts = np.unique(t, return_counts=True)
                    yield exchange.requests(r["block"], keys, counts, n_parts)

    return packed.select("block", "kept", "chosen", "tokens").mapInArrow(tidy(run), exchange.REQUEST)


def _entries(packed: DataFrame, replies: DataFrame, n_parts: int, percent: int) -> DataFrame:
    """Prefix entries (ENTRY) of all documents: shingles that some other document may share."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("token", "sig", "n", "pos", "level", "score")}
        for r in left.to_pylist():
            tokens = np.frombuffer(r["tokens"], exchange.U64)
            kept, chosen = np.array(r["kept"], dtype=np.int64), np.array(r["chosen"], dtype=np.int64)
            mask = _chosen(tokens, kept, chosen)
            keys = np.unique(tokens[mask])
            df = np.ones(len(tokens), dtype=np.int64)
            if len(keys):
                df[mask] = exchange.collect_replies(right, keys, n_parts)[np.searchsorted(keys, tokens[mask])]
            ends = np.cumsum(kept)
            for sig, n, k, c, end in zip(r["sig"], r["n"], kept, chosen, ends):
                if not n:
                    continue
                t, f = tokens[end - k:end], df[end - k:end]
                o = np.concatenate([np.argsort(f[:c], kind="stable"), np.arange(c, k)])  # by (frequency, hash), then hash
                base = n - (percent * n + 99) // 100
                o = o[:base + LEVELS]
                others = np.cumsum(f[o] - 1)
                sums = [others[min(base + lv, len(o)) - 1] for lv in range(1, LEVELS + 1)]
                level = 1 + int(np.argmin([s * (1 + n / 8 / lv) for lv, s in enumerate(sums, 1)]))
                o = o[:base + level]
                # a shingle of one document cannot be shared; frequencies of the rest are unknown
                use = np.flatnonzero((f[o] > 1) | (o >= c))
                out["token"].append(t[o[use]].view(np.int64))
                out["pos"].append(use)
                out["sig"] += [sig] * len(use)
                out["n"].append(np.full(len(use), n))
                out["level"].append(np.full(len(use), level))
                out["score"].append(np.full(len(use), f[:c].mean() if c else 1.0))
        cat = lambda k, kind: pa.array(np.concatenate([np.zeros(0, kind), *out[k]]).astype(kind))
        return pa.table({"token": cat("token", np.int64), "sig": pa.array(out["sig"], pa.binary()), "n": cat("n", np.int32),
                         "pos": cat("pos", np.int32), "level": cat("level", np.int32), "score": cat("score", np.float64)})

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(tidy_group(one), ENTRY)


def _by_bytes(b: pa.RecordBatch, *columns: str, size: int = 4_000_000):
    """A batch in slices of about ``size`` bytes in some columns, so that no task holds a whole batch as objects."""
    n = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    part = (np.cumsum(n) - n) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield b.slice(i, j - i)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sig, shingles) of the wanted classes (sig, tkey), rebuilt from one text each."""

    def run(batches):
        for b in batches:
            for part in _by_bytes(b, "text"):
                sets = [shingles.shingle_set(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shingles.signature(s) for s in sets], pa.binary()),
                     pa.array([s.astype(exchange.U64).tobytes() for s in sets], pa.binary())], names=["sig", "shingles"])

    d = docs.select(whole_text().alias("text")).withColumn("tkey", F.xxhash64("text"))
    d = d.join(wanted.select("tkey"), "tkey", "left_semi").select("text").dropDuplicates(["text"])
    return d.mapInArrow(tidy(run), "sig binary, shingles binary").join(wanted.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])


def _repack(sets: DataFrame, tokens: int = 500_000) -> DataFrame:
    """Sets as blocks of the form that ``_requests`` and ``_entries`` read, with all shingles ordered by frequency."""

    def run(batches):
        ids = exchange.block_ids()
        for b in batches:
            for part in _by_bytes(b, "shingles", size=8 * tokens):
                sig, data = part.column("sig").to_pylist(), part.column("shingles").to_pylist()
                n = [len(x) // 8 for x in data]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(ids)], pa.int64()), pa.array([sig], pa.list_(pa.binary())),
                     *[pa.array([n], pa.list_(pa.int32()))] * 3, pa.array([b"".join(data)], pa.binary())],
                    names=["block", "sig", "n", "kept", "chosen", "tokens"])

    return sets.select("sig", "shingles").mapInArrow(
        tidy(run), "block long, sig array<binary>, n array<int>, kept array<int>, chosen array<int>, tokens binary")


def _may_match(n: str, pos: str, level: str | None, other_n: str, other_pos: str, other_level: str | None, percent: int) -> Column:
    """Both entries lie in the prefixes that count for a pair of these sizes and levels (None: level 1)."""
    n, pos, other_n, other_pos = F.col(n), F.col(pos), F.col(other_n), F.col(other_pos)
    need = F.ceil(F.lit(percent) * (n + other_n) / (100 + percent))
    deep = (F.least(level, other_level) if level else F.lit(1)) - need
    return ((n * 100 >= other_n * percent) & (other_n * 100 >= n * percent) & (pos < n + deep) & (other_pos < other_n + deep))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches):
        for b in batches:
            for part in _by_bytes(b, "sa", "sb"):
                good = []
                for v, w in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist()):
                    s, t = np.frombuffer(v, exchange.U64), np.frombuffer(w, exchange.U64)
                    i = np.searchsorted(t, s)
                    same = int((t[np.minimum(i, len(t) - 1)] == s).sum())
                    good.append(100 * same >= percent * (len(s) + len(t) - same))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(good)], names=["a", "b", "linked"])

    j = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("sa")), "a")
    j = j.join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("sb")), "b")
    return j.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a binary, b binary, linked boolean")


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, components): every document with its class, and every linked class with its component's root.

    members: doc_id, sig, n_shingles; components: node, root (signatures).
    """
    spark = docs.sparkSession
    packed = cut(pack(docs, words, percent), "packed")
    n_parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _requests(packed, n_parts)
    entries = _entries(packed.select("block", "sig", "n", "kept", "chosen", "tokens"), exchange.totals(asked), n_parts, percent)
    members = packed.select(F.explode(F.arrays_zip("doc_id", "tkey", "sig", "n")).alias("d")).select(
        "d.doc_id", "d.tkey", "d.sig", F.col("d.n").cast("long").alias("n_shingles"))
    # classes that share a prefix shingle with another class; only these go on, with their full sets
    entries = cut(entries.select("token", "sig").distinct(), "first_entries")
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token")
    active = entries.join(shared, "token", "left_semi").select("sig").distinct()
    classes = members.where("n_shingles > 0").groupBy("sig").agg(F.min("tkey").alias("tkey"))
    wanted = cut(classes.join(active, "sig"), "wanted")
    sets = cut(_sets(docs, wanted, words), "sets")

    # their prefixes, now with every shingle ordered by its frequency among them
    whole = cut(_repack(sets), "whole")
    entries = cut(_entries(whole, exchange.totals(_requests(whole, n_parts)), n_parts, percent), "entries")
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("score", "sig")).alias("h")).where("m > 1")
    shared = shared.select("token", F.col("h.sig").alias("hub"))
    entries = cut(entries.join(shared, "token"), "shared")

    # round 1: every class with the hubs of its shingles
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    own = entries.where(F.col("sig") == F.col("hub")).select(
        F.col("token").alias("ht"), F.col("n").alias("hn"), F.col("pos").alias("hpos"), F.col("level").alias("hlevel"))
    first = entries.where(F.col("sig") != F.col("hub")).join(own, F.col("token") == F.col("ht"))
    first = first.where(_may_match("n", "pos", "level", "hn", "hpos", "hlevel", percent))
    first = first.select(*pair(F.col("sig"), F.col("hub"))).distinct()
    tried = cut(verified(first, sets, percent), "round1")
    found = tried.where("linked").select("a", "b")
    comp = exchange.components(found, "comp1")

    # round 2: pairs that share enough of their prefixes and are still apart
    e = entries.join(comp.select(F.col("node").alias("sig"), "root"), "sig", "left")
    e = e.withColumn("root", F.coalesce("root", "sig")).drop("hub", "score")
    apart = e.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    e = cut(e.join(apart, "token", "left_semi"), "apart")
    x, y = (e.select("token", *[F.col(c).alias(p + c) for c in ("sig", "n", "pos", "level", "root")]) for p in "xy")
    # with l shared shingles in the prefixes, the first of them lies within the prefixes of level 1: these make the pairs
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("xsig") < F.col("ysig")) & (F.col("xroot") != F.col("yroot"))
                   & _may_match("xn", "xpos", None, "yn", "ypos", None, percent))
    pairs = pairs.select(F.col("xsig").alias("a"), F.col("ysig").alias("b")).distinct()
    held = e.groupBy("sig").agg(F.min("n").alias("n"), F.min("level").alias("level"), F.collect_list(F.struct("pos", "token")).alias("p"))
    for k in "ab":
        pairs = pairs.join(held.select(F.col("sig").alias(k), *[F.col(c).alias(k + c) for c in ("n", "level", "p")]), k)
    need = F.ceil(F.lit(percent) * (F.col("an") + F.col("bn")) / (100 + percent))
    level = F.least("alevel", "blevel")
    inside = lambda k: F.transform(F.filter(k + "p", lambda t: t["pos"] < F.col(k + "n") - need + level), lambda t: t["token"])
    pairs = pairs.where(F.size(F.array_intersect(inside("a"), inside("b"))) >= level).select("a", "b")
    pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = cut(verified(pairs, sets, percent).where("linked").select("a", "b"), "round2")
    comp = exchange.components(found.unionByName(more), "comp2")
    return members, comp


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links, itself included), and ``sig`` of its class."""
    members, comp = links(docs, words, percent)
    classes = members.groupBy("sig").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"))
    classes = classes.join(comp.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    roots = classes.groupBy("root").agg(F.min("least").alias("component"))
    labels = classes.where("n > 0").join(roots, "root").select(F.col("sig").alias("_sig"), "component")
    out = members.join(labels, members["sig"] == labels["_sig"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
                      .alias("component_id"), "sig")


def survivors(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tkey): the row of each component that has the least (doc_id, text hash), null ids last.

    ``tkey`` is ``xxhash64`` of the text (null is empty).  Rows without a word are linked with nothing: each
    distinct (doc_id, tkey) of theirs is returned.  The pairs are distinct.
    """
    members, comp = links(docs, words, percent)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey")
    classes = members.where("n_shingles > 0").groupBy("sig").agg(F.min(row).alias("row"))
    classes = classes.join(comp.select(F.col("node").alias("sig"), "root"), "sig", "left")
    best = classes.groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("row").alias("row")).select("row.doc_id", "row.tkey")
    return best.unionByName(members.where("n_shingles = 0").select("doc_id", "tkey").distinct())
