"""Operator 12: a trie of conversation prefixes, as balanced parentheses per shard.

Conversations are sequences of turns (role, text).  A node is a distinct sequence
of first turns; what a cache of shared prefixes would save is added up over the
node's subtree.

1. Prefix names.  A turn is two residues modulo 2**61 - 1, a prefix of depth d the
   sums of turn * base**place over its turns: two running sums over all turns in
   (conversation, place) order, less their value before the conversation.  Running
   sums cross partitions by one total per partition, so a conversation of any
   length is spread over many tasks.  Two prefixes of depth d share a name with a
   probability of about (d / 2**61) ** 2.
2. Preorder.  Conversations are sorted by the names of their nodes that have
   siblings (then by length and id), which keeps every subtree together.  A node
   stands with the first conversation that holds it; nodes in the order of (that
   conversation, depth) are the trie in preorder.
3. Shards of ``SHARD_NODES`` consecutive nodes are encoded as balanced parentheses.
   The excess (open less closed) has a minimum per block and a tree of these
   minima; findclose delimits a node's subtree, the rank of ``()`` pairs counts its
   leaves, cumulative arrays give its savings.
4. Shared spines.  Parentheses still open at a shard's end are the path to its
   last node.  A shard's new minima of depth close them: which shard closes whose
   path follows from one row per shard (first, least and last depth), the closing
   places then travel to the shards that wait for them, and the parts merge.

Scale: no conversation, node or subtree is held in one row or task; a sort key
has at most about the square root of twice the number of turns, as each of its
entries needs another conversation of that length.  The driver holds one row per
shard.  A node's ids are hashed by one task, since SHA-256 is sequential, from
chunks of ``CHUNK_IDS`` ids streamed in order.

Defined cases: null role or text is empty; equal turn numbers are ordered by a hash of
role and text; rows with a null conv_id are one conversation of its own, which
takes no other's turns, has an id only beside others (the least id that is not
null) and is left out of the list of ids; repeated rows are repeated turns; extra
columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .ordered import in_order, numbered, offsets, runs
from .residues import PRIME, mulmod, powmod, running

BASES = (0x0F3A9D1E5B7C2461, 0x1C64E8A2907D3BF5)
SHARD_NODES = 1 << 16
BLOCK_BITS = 64
CHUNK_IDS = 4096
NODE = ["depth", "p1", "p2"]
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


# -- conversations ----------------------------------------------------------------

def _residue(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "role", "text"), F.lit(PRIME))


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (c, d, t1, t2, n_bytes) and conversations (c, length), with the first turns of another one.

    Conversation c starts with the first h turns of conversation c - c % ``group`` and goes on with its own
    after its first h; h is crc32(c) % ``most``.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    t = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
                             text("role").alias("role"), text("text").alias("text"))
    t = t.select("c", "turn", _residue(1).alias("t1"), _residue(2).alias("t2"), F.octet_length("text").cast("long").alias("n_bytes"))
    t = numbered(t, ["c", "turn", "t1", "t2"], "row", "turns")
    own = t.groupBy("c").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    own = own.withColumn("source", F.col("c") - F.col("c") % group).withColumn(
        "h", (F.crc32(F.col("c").cast("string").cast("binary")) % most).cast("long"))
    lengths = own.select(F.col("c").alias("source"), F.col("n").alias("source_n"))
    own = own.join(lengths, "source", "left")
    taken = F.when(F.col("source") != F.col("c"), F.least("h", F.coalesce("source_n", F.lit(0)))).otherwise(F.lit(0))
    skipped = F.when(F.col("source") != F.col("c"), F.col("h")).otherwise(F.lit(0))
    own = cut(own.withColumn("taken", taken).withColumn("skipped", skipped).select(
        "c", "first", "n", "source", "taken", "skipped",
        (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("skipped"))).alias("length")), "conversations")
    t = t.join(own.select(F.col("c").alias("_c"), "first", "skipped", "taken"), F.col("c").eqNullSafe(F.col("_c")))
    t = t.withColumn("d", F.col("row") - F.col("first") + 1)
    turn = ["t1", "t2", "n_bytes"]
    rest = t.where("d > skipped").select("c", (F.col("d") - F.col("skipped") + F.col("taken")).alias("d"), *turn)
    lent = t.where(f"d < {most}").select(F.col("c").alias("source"), "d", *turn)
    lent = lent.join(own.where("taken > 0").select("c", "source", "taken"), "source").where("d <= taken").select("c", "d", *turn)
    return cut(rest.unionByName(lent), "rebuilt"), own.select("c", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """The turns with the names of the prefix that ends with them (p1, p2) and of the one before (q1, q2)."""

    def run(batches):
        pid, before = TaskContext.get().partitionId(), [0, 0]
        for b in batches:
            d = b.column("d").to_numpy(zero_copy_only=False)
            cols = []
            for k, (t, base) in enumerate(zip(("t1", "t2"), BASES)):
                u = mulmod(b.column(t).to_numpy(zero_copy_only=False).astype(np.uint64), powmod(base, d))
                s = running(u, before[k])
                before[k] = int(s[-1]) if len(s) else before[k]
                cols += [pa.array(u.astype(np.int64)), pa.array(s.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("d"), b.column("n_bytes"), pa.array(np.full(len(d), pid, np.int64)), *cols],
                                             names=["c", "d", "n_bytes", "_pid", "u1", "s1", "u2", "s2"])

    d = in_order(turns, ["c", "d"], ties=False).select("c", "d", "n_bytes", "t1", "t2")
    d = cut(d.mapInArrow(run, "c long, d long, n_bytes long, _pid long, u1 long, s1 long, u2 long, s2 long"), "sums")
    for k in "12":
        parts = d.groupBy("_pid").agg((F.sum(F.col("u" + k).cast("decimal(38,0)")) % PRIME).cast("long").alias("n"))
        before = offsets(parts, "n").select("_pid", (F.col("before") % PRIME).cast("long").alias("before"))
        d = d.join(F.broadcast(before), "_pid").withColumn("s" + k, (F.col("s" + k) + F.col("before")) % PRIME).drop("before")
    start = d.where("d = 1").select(F.col("c").alias("_c"), *[F.pmod(F.col("s" + k) - F.col("u" + k), F.lit(PRIME)).alias("o" + k) for k in "12"])
    d = d.join(start, F.col("c").eqNullSafe(F.col("_c")))
    p = {k: F.pmod(F.col("s" + k) - F.col("o" + k), F.lit(PRIME)) for k in "12"}
    q = {k: F.pmod(F.col("s" + k) - F.col("o" + k) - F.col("u" + k), F.lit(PRIME)) for k in "12"}
    d = d.select("c", F.col("d").alias("depth"), "n_bytes", p["1"].alias("p1"), p["2"].alias("p2"), q["1"].alias("q1"), q["2"].alias("q2"))
    return cut(d, "prefixes")


def ranks(names: DataFrame, conversations: DataFrame) -> DataFrame:
    """(c, length, rank): conversations in an order that keeps every subtree together."""
    several = names.where("depth > 1").select("depth", "q1", "q2", "p1", "p2").distinct().groupBy("depth", "q1", "q2").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select("depth", "q1", "q2")
    forks = names.where("depth > 1").join(several, ["depth", "q1", "q2"], "left_semi").unionByName(names.where("depth = 1"))
    keys = forks.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("depth", "p1", "p2"))).alias("forks"))
    keys = conversations.join(keys.withColumnRenamed("c", "_c"), F.col("c").eqNullSafe(F.col("_c")), "left")
    empty = F.array().cast("array<struct<depth: bigint, p1: bigint, p2: bigint>>")
    keys = keys.select("c", "length", F.coalesce("forks", empty).alias("forks"))
    return numbered(keys, ["forks", "length", "c"], "rank", "ranks", ties=False).select("c", "length", "rank")


# -- nodes and shards ---------------------------------------------------------------

class Parens:
    """Balanced parentheses of a run of nodes in preorder, from their depths."""

    def __init__(self, depth: np.ndarray, next_depth: int | None):
        n = len(depth)
        follow = np.append(depth[1:], next_depth if next_depth is not None else depth[-1] + 1)
        open_ = depth - np.minimum.accumulate(depth) + 1        # parentheses of this run that are open after each node
        closes = np.minimum(np.maximum(depth - follow + 1, 0), open_)
        self.at = np.arange(n) + np.concatenate([[0], np.cumsum(closes[:-1])]).astype(np.int64)   # each node's "("
        size = int(n + closes.sum())
        self.bits = np.zeros(size, bool)
        self.bits[self.at] = True
        self.excess = np.cumsum(np.where(self.bits, 1, -1))
        self.opened = np.cumsum(self.bits)
        pairs = self.bits.copy()
        pairs[:-1] &= ~self.bits[1:]
        if size:
            pairs[-1] = False
        self.leaves = np.concatenate([[0], np.cumsum(pairs)])   # "()" pairs that start before a place
        pad = -size % BLOCK_BITS
        level = np.append(self.excess, np.full(pad, np.iinfo(np.int64).max)).reshape(-1, BLOCK_BITS).min(axis=1)
        self.levels = [level]
        while len(level) > 1:
            level = np.append(level, np.iinfo(np.int64).max) if len(level) % 2 else level
            self.levels[-1] = level
            level = level.reshape(-1, 2).min(axis=1)
            self.levels.append(level)

    def _scan(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from ``start`` on, in its block, whose excess is at most ``target``; -1 if none."""
        found, block = np.full(len(start), -1), start // BLOCK_BITS
        for step in range(BLOCK_BITS):
            at = start + step
            left = np.flatnonzero((found < 0) & (at // BLOCK_BITS == block) & (at < len(self.excess)))
            if not len(left):
                break
            hit = left[self.excess[at[left]] <= target[left]]
            found[hit] = at[hit]
        return found

    def _next_block(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First later block whose least excess is at most ``target``; -1 if none: up the tree of minima, then down."""
        out, node, level = np.full(len(block), -1), block.copy(), np.zeros(len(block), np.int64)
        up = np.arange(len(block))
        down = []
        for k, mins in enumerate(self.levels[:-1]):
            right = up[(node[up] % 2 == 0) & (mins[np.minimum(node[up] + 1, len(mins) - 1)] <= target[up])]
            node[right] += 1
            level[right] = k
            down.append(right)
            up = np.setdiff1d(up, right, assume_unique=True)
            node[up] //= 2
        for k in range(len(self.levels) - 2, -1, -1):
            for right in down[k:k + 1]:
                out[right] = 0
            active = np.flatnonzero((out == 0) & (level > k))
            node[active] *= 2
            node[active] += self.levels[k][node[active]] > target[active]
        return np.where(out == 0, node, -1)

    def findclose(self) -> np.ndarray:
        """The place of every node's ")"; -1 where it lies beyond this run."""
        target = self.excess[self.at] - 1
        found = self._scan(self.at, target)
        left = np.flatnonzero(found < 0)
        if len(left) and len(self.levels) > 1:
            block = self._next_block(self.at[left] // BLOCK_BITS, target[left])
            left, block = left[block >= 0], block[block >= 0]
            found[left] = self._scan(block * BLOCK_BITS, target[left])
        return found


def _minima(depth: np.ndarray) -> np.ndarray:
    """Places where a run of depths reaches a new minimum."""
    least = np.minimum.accumulate(depth)
    return np.flatnonzero(np.append(True, least[1:] < least[:-1]))


SPINE = "shard long, is_total boolean, depth long, upto long, least long, leaves long, saved long"


def _spines(nodes: DataFrame) -> DataFrame:
    """Per shard its new minima of depth, each with what stands before it and the depths it closes, and a row of totals."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        depth, saved = t.column("depth").to_numpy(), np.concatenate([[0], np.cumsum(t.column("own").to_numpy())])
        leaf = np.concatenate([[0], np.cumsum(np.append(depth[1:] <= depth[:-1], False))])   # the last node's leaf follows from the next shard
        at = _minima(depth)
        upto = np.append(np.iinfo(np.int64).max, depth[at[:-1]] - 1)
        n = len(at) + 1
        return pa.table({
            "shard": pa.array([t.column("shard")[0].as_py()] * n, pa.int64()), "is_total": pa.array([False] * (n - 1) + [True]),
            "depth": pa.array(np.append(depth[at], depth[-1])), "upto": pa.array(np.append(upto, depth[0])),
            "least": pa.array([int(depth.min())] * n, pa.int64()),
            "leaves": pa.array(np.append(leaf[at], leaf[-1])), "saved": pa.array(np.append(saved[at], saved[-1]))})

    return nodes.select("shard", "place", "depth", "own").groupBy("shard").applyInArrow(one, SPINE)


def merge_spines(totals: list) -> tuple[list[tuple], list[tuple]]:
    """From one row per shard in order (first=upto, least, last=depth, leaves, saved): what each shard must know.

    Returns (shard, next shard's first depth, leaves before, saved before) and (shard, closing shard, lo, hi):
    the depths lo to hi of the first shard's open path are closed by the second (None: by the end).
    """
    bases, pairs, path = [], [], []
    leaves = saved = 0
    for k, r in enumerate(totals):
        follow = totals[k + 1]["upto"] if k + 1 < len(totals) else None
        while path and path[-1][2] >= r["least"]:
            shard, lo, hi = path.pop()
            pairs.append((shard, r["shard"], max(lo, r["least"]), hi))
            if lo < r["least"]:
                path.append((shard, lo, r["least"] - 1))
        path.append((r["shard"], r["least"], r["depth"]))
        bases.append((r["shard"], follow, leaves, saved))
        leaves += r["leaves"] + (follow is None or follow <= r["depth"])
        saved += r["saved"]
    end = [(shard, None, lo, hi, leaves, saved) for shard, lo, hi in path]
    return bases, pairs + end


CLOSING = "shard long, is_base boolean, lo long, hi long, leaves long, saved long"
FOUND = "depth long, p1 long, p2 long, n_leaves long, saved_tokens long"


def _subtrees(nodes: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of every node."""
    spark = nodes.sparkSession
    spines = cut(_spines(nodes), "spines")
    totals = [r.asDict() for r in spines.where("is_total").orderBy("shard").collect()]   # one row per shard
    bases, pairs = merge_spines(totals)
    base_of = {s: (leaves, saved) for s, _, leaves, saved in bases}
    rows = [(s, True, -1 if follow is None else follow, None, leaves, saved) for s, follow, leaves, saved in bases]
    rows += [(s, False, lo, hi, *total) for s, by, lo, hi, *total in pairs if by is None]
    own = spark.createDataFrame(rows, CLOSING)
    waits = spark.createDataFrame([(s, by, lo, hi, *base_of[by]) for s, by, lo, hi, *_ in pairs if by is not None],
                                  "waiting long, by long, lo long, hi long, b_leaves long, b_saved long")
    # each closing shard's minima go to the shards whose open paths they close
    m = spines.where("not is_total").join(waits, F.col("shard") == F.col("by")).where("depth <= hi and upto >= lo")
    m = m.select(F.col("waiting").alias("shard"), F.lit(False).alias("is_base"), F.greatest("depth", "lo").alias("lo"), F.least("upto", "hi").alias("hi"),
                 (F.col("leaves") + F.col("b_leaves")).alias("leaves"), (F.col("saved") + F.col("b_saved")).alias("saved"))

    def one(t: pa.Table, closings: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table({k: pa.array([], pa.int64()) for k in ("depth", "p1", "p2", "n_leaves", "saved_tokens")})
        t = t.sort_by("place")
        c = closings.to_pylist()
        base = next(r for r in c if r["is_base"])
        c = sorted((r for r in c if not r["is_base"]), key=lambda r: r["lo"])
        depth = t.column("depth").to_numpy()
        parens = Parens(depth, base["lo"] if base["lo"] >= 0 else 0)
        close = parens.findclose()
        saved = np.concatenate([[0], np.cumsum(t.column("own").to_numpy())])
        inside, start = np.maximum(close, 0), parens.leaves[parens.at]
        n_leaves = parens.leaves[inside] - start
        n_saved = saved[parens.opened[inside]] - saved[:-1]
        far = np.flatnonzero(close < 0)
        if len(far):
            k = np.searchsorted([r["lo"] for r in c], depth[far], side="right") - 1
            n_leaves[far] = np.array([r["leaves"] for r in c], dtype=np.int64)[k] - base["leaves"] - start[far]
            n_saved[far] = np.array([r["saved"] for r in c], dtype=np.int64)[k] - base["saved"] - saved[:-1][far]
        return pa.table({"depth": t.column("depth"), "p1": t.column("p1"), "p2": t.column("p2"),
                         "n_leaves": pa.array(n_leaves), "saved_tokens": pa.array(n_saved)})

    kept = nodes.select("shard", "place", "depth", "own", "p1", "p2")
    return kept.groupBy("shard").cogroup(own.unionByName(m).groupBy("shard")).applyInArrow(one, FOUND)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) from (depth, p1, p2, rank, c): ids ascending, joined by commas."""
    chunk = F.floor(F.col("rank") / CHUNK_IDS).alias("chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",")
    packed = ends.groupBy(*NODE, chunk).agg(ids.alias("ids"))   # equal sequences are neighbours in rank, by ascending id

    def run(batches):
        for key, group in groupby(runs(batches, lambda r: (r["depth"], r["p1"], r["p2"])), lambda x: x[0]):
            sha, first = hashlib.sha256(), True
            for _, r in group:
                if r["ids"]:
                    sha.update((r["ids"] if first else "," + r["ids"]).encode())
                    first = False
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([sha.hexdigest()])], names=[*NODE, "ends_sha256"])

    order = [*NODE, "chunk"]
    return packed.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 5, most: int = 9, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(conversations, group, most)
    names = prefixes(turns)
    order = ranks(names, convs)
    order_ = order.select(F.col("c").alias("_c"), "length", "rank")
    held = names.join(order_, F.col("c").eqNullSafe(F.col("_c")))
    nodes = held.groupBy(*NODE).agg(
        F.min("rank").alias("first"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes"),
        F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    zero = F.lit(0).cast("long")
    root = order.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), F.lit(-1).cast("long").alias("first"), "conv_id", "n_convs",
        zero.alias("n_bytes"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    nodes = nodes.unionByName(root).withColumn("own", (F.col("n_convs") - 1) * F.col("n_bytes"))
    nodes = numbered(nodes, ["first", "depth"], "place", "nodes", ties=False).withColumn("shard", F.floor(F.col("place") / shard_nodes))
    found = _subtrees(nodes)
    above = (F.col("depth") - 1).alias("depth")
    children = nodes.where("depth > 0").groupBy(above, F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    ends = held.where("depth = length").select(*NODE, "rank", "c").unionByName(
        order.where("length = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "rank", "c"))
    out = nodes.join(parents, ["depth", "q1", "q2"], "left").join(children, NODE, "left").join(found, NODE).join(_end_hashes(ends), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
                      "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"))
