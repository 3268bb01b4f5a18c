"""Counting packed keys over all blocks of a table, and connected components.

A block (a few MB of documents) sends its distinct 64-bit keys, sorted and
packed, to partitions of the key space; each partition adds the counts up over
all blocks and sends every block its own keys' totals back.  Two shuffles of
packed arrays replace a shuffle and a join of single rows.  Rows: one for each
block and partition of the key space that share a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy_group

U64 = "<u8"
REQUEST = "block long, part long, keys binary, counts binary"
MOST_ROUNDS = 100   # star steps; every two halve distances, so 2**50 nodes in a row would need them
REPLY = "block long, part long, totals binary"


def block_ids():
    """Ids of the blocks that a task makes: its partition in the high bits."""
    n = TaskContext.get().partitionId() << 32
    while True:
        yield n
        n += 1


def parts_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(n_parts)).astype(np.int64)


def by_part(part: np.ndarray) -> np.ndarray:
    """The order of ascending keys by part of the key space and key: a stable sort of the parts alone (16 bits are sorted by digits)."""
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")


def pairs_in_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys of two words each; the second words are looked at only if equal first ones have different second ones."""
    first, second = np.ascontiguousarray(keys[:, 0]), keys[:, 1]
    order = np.argsort(first)
    same = first[order[1:]] == first[order[:-1]]
    if (second[order[1:]] != second[order[:-1]])[same].any():
        order = np.lexsort((second, first))
    return order


def requests(block: int, keys: np.ndarray, counts: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """The request rows of a block; ``keys`` distinct."""
    part = parts_of(keys, n_parts)
    order = by_part(part) if (keys[1:] > keys[:-1]).all() else np.lexsort((keys, part))
    keys, counts, part = keys[order].astype(U64), counts[order].astype("<u4"), part[order]
    own, first = np.unique(part, return_index=True)
    cuts = [*first.tolist(), len(keys)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(own), block, dtype=np.int64)), pa.array(own),
         pa.array([keys[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
         pa.array([counts[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())],
        names=["block", "part", "keys", "counts"])


def totals(asked: DataFrame) -> DataFrame:
    """Replies: for every request the totals (u4) of its keys over all requests."""

    def add(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, U64) for x in t.column("keys").to_pylist()]
        n = [len(k) for k in keys]
        all_, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("counts").to_pylist()])
        total = np.minimum(np.bincount(inverse, weights=counts, minlength=len(all_)), 2**32 - 1).astype("<u4")[inverse]
        ends = np.cumsum(n)
        return pa.table({"block": t.column("block"), "part": t.column("part"),
                         "totals": pa.array([total[e - k:e].tobytes() for e, k in zip(ends, n)], pa.binary())})

    return asked.groupBy("part").applyInArrow(tidy_group(add), REPLY)


def ask_repeated(block: int, keys: np.ndarray, counts: np.ndarray, n_parts: int, width: int = 8) -> pa.RecordBatch:
    """Request rows that send the low ``width`` bytes of each key and whether the block holds it twice."""
    b = requests(block, keys, np.minimum(counts, 2), n_parts)
    short = [np.frombuffer(x, np.uint8).reshape(-1, 8)[:, :width].tobytes() for x in b.column("keys").to_pylist()]
    twice = [np.frombuffer(x, "<u4").astype(np.uint8).tobytes() for x in b.column("counts").to_pylist()]
    return pa.RecordBatch.from_arrays([b.column("block"), b.column("part"), pa.array(short, pa.binary()),
                                       pa.array(twice, pa.binary())], names=["block", "part", "keys", "counts"])


def repeated(asked: DataFrame, width: int = 8) -> DataFrame:
    """Replies: one byte per key, 1 if it occurs twice or more over all requests."""

    def add(t: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x, np.uint8).reshape(-1, width) for x in t.column("keys").to_pylist()]
        wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
        wide[:, :width] = np.concatenate(raw)
        keys = wide.reshape(-1).view(U64)
        more = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8) > 1
        order = np.argsort(keys)   # any order of equal keys will do
        same = keys[order[1:]] == keys[order[:-1]]
        flag = np.zeros(len(keys), np.uint8)
        flag[order[1:][same]] = 1
        flag[order[:-1][same]] = 1
        flag |= more
        ends = np.cumsum([len(x) for x in raw])
        return pa.table({"block": t.column("block"), "part": t.column("part"),
                         "totals": pa.array([flag[e - len(x):e].tobytes() for e, x in zip(ends, raw)], pa.binary())})

    return asked.groupBy("part").applyInArrow(tidy_group(add), REPLY)


PAIR = np.dtype([("first", "<u8"), ("second", "<u4")])   # a key of 12 bytes, as it is sent


def _packed_pairs(keys: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys), PAIR)
    out["first"], out["second"] = keys[:, 0], keys[:, 1]
    return out


def pair_order(keys: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct keys (64 and 32 bits) by part of the key space and key, and their parts."""
    part = parts_of(keys[:, 0], n_parts)
    first, second = keys[:, 0], keys[:, 1]
    ascending = ((first[1:] > first[:-1]) | ((first[1:] == first[:-1]) & (second[1:] > second[:-1]))).all()
    return by_part(part) if ascending else np.lexsort((second, first, part)), part


def ask_repeated_pairs(block: int, keys: np.ndarray, counts: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """Request rows for distinct keys of 64 and 32 bits: the keys, and whether the block holds each twice (a bit)."""
    order, part = pair_order(keys, n_parts)
    packed, twice, part = _packed_pairs(keys[order]), counts[order] > 1, part[order]
    own, first = np.unique(part, return_index=True)
    cuts = [*first.tolist(), len(keys)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(own), block, dtype=np.int64)), pa.array(own),
         pa.array([packed[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
         pa.array([np.packbits(twice[i:j]).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())],
        names=["block", "part", "keys", "counts"])


def repeated_pairs(asked: DataFrame) -> DataFrame:
    """Replies: one bit per key of ``ask_repeated_pairs``, 1 if it occurs twice or more over all requests."""

    def add(t: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x, PAIR) for x in t.column("keys").to_pylist()]
        keys = np.concatenate(raw)
        flag = np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8), count=len(k)) for c, k in zip(t.column("counts").to_pylist(), raw)])
        wide = np.stack([keys["first"], keys["second"].astype(U64)], axis=1)
        order = pairs_in_order(wide)
        same = (wide[order[1:]] == wide[order[:-1]]).all(axis=1)
        flag[order[1:][same]] = 1
        flag[order[:-1][same]] = 1
        ends = np.cumsum([len(x) for x in raw])
        return pa.table({"block": t.column("block"), "part": t.column("part"),
                         "totals": pa.array([np.packbits(flag[e - len(x):e]).tobytes() for e, x in zip(ends, raw)], pa.binary())})

    return asked.groupBy("part").applyInArrow(tidy_group(add), REPLY)


def collect_pairs(t: pa.Table, keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The flags of a block's distinct ``keys`` (two words each, any order) from its reply rows."""
    order, part = pair_order(keys, n_parts)
    sizes = np.unique(part, return_counts=True)[1].tolist()
    rows = sorted(zip(t.column("part").to_pylist(), t.column("totals").to_pylist()))
    out = np.zeros(len(keys), bool)
    out[order] = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for (_, x), n in zip(rows, sizes)]) > 0
    return out


def collect_replies(t: pa.Table, keys: np.ndarray, n_parts: int, kind: str = "<u4") -> np.ndarray:
    """The totals (``repeated``: flags, kind u1) of a block's ``keys`` (distinct, any order) from its reply rows."""
    part = parts_of(keys, n_parts)
    order = by_part(part) if (keys[1:] > keys[:-1]).all() else np.lexsort((keys, part))
    rows = sorted(zip(t.column("part").to_pylist(), t.column("totals").to_pylist()))
    got = np.frombuffer(b"".join(x for _, x in rows), kind)
    out = np.zeros(len(keys), dtype=np.int64)
    out[order] = got
    return out


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node in ``edges`` (columns a, b of one orderable type): root is the least node reachable.

    Large and small star steps in turn; each links a node's neighbours to the
    least of them, which halves distances, until the stars do not change.  Every
    step is joins and minima with map-side combine, cut into the shared folder.
    Raises ``RuntimeError`` rather than returning unfinished components.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e, f"{name}_0")
    before = None
    for k in range(1, MOST_ROUNDS + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u hang on the least of u and its neighbours
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where(F.col("u") != F.col("v")).distinct(), f"{name}_l{k}")
        # small star: u and its smaller neighbours hang on the least of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            m.select("u", F.col("m").alias("v")))
        e = cut(small.where(F.col("u") != F.col("v")).distinct(), f"{name}_{k}")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components of {name} still change after {MOST_ROUNDS} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
