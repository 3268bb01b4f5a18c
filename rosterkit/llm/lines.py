"""Operator 11: line dedup with two Bloom filters, of once-seen and of twice-seen line hashes.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
Keys of at least ``min_chars`` code points that stand in at least ``min_docs``
documents lose all their lines except in the largest doc_id that holds them.

1. ``pack``: documents become blocks of a few MB: compressed texts, and the
   128-bit hash of every long line.
2. Filters.  The hash space is dealt into shards of about ``SHARD_KEYS`` hashes,
   counted before, so a shard's two filters have a fixed size at any input size.
   A block sends each shard its distinct hashes (5 bytes each) and whether it
   holds them in two documents.  A shard takes the blocks one after the other: a
   hash that the first filter has seen enters the second.  Then it tells every
   block which of its hashes the second filter holds: the suspected repeats.
3. Only suspected repeats are shuffled: (hash, doc_id) rows, up to ``min_docs``
   of the largest ids a block and hash, are made distinct and counted, which
   settles the false ones and finds the largest id.  Confirmation compares
   128-bit hashes, not the lines' bytes (two of 10**12 lines share one by chance
   with a probability below 10**-14).
4. Every block gets its confirmed hashes with their largest ids, and drops lines.

Scale: texts are written once, compressed, and shuffled once by block; hashes of
lines that occur once travel only as 5 bytes to their shard.  A hot line sends
one row a block (``min_docs`` in step 3), counted with map-side combine.  A
block's confirmed hashes are bounded by its own lines.

Defined cases: rows with one doc_id are one document, also where it is null (null
is below every id); null text is empty; an empty text is one empty line, which is
too short to drop; a text whose lines are all dropped is empty; repeated rows give one result
row each; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import cut, tidy, tidy_group, whole_text

MIN_CHARS = 40
MIN_DOCS = 5
SPACE = " \t\n\v\f\r"
BLOCK_CHARS = 4_000_000
SHARD_KEYS = 1 << 20     # hashes of a shard, at most about so many
BITS_PER_KEY = 12        # bits of each filter for a hash
PROBES = 4
WIDTH = 5                # bytes of a hash that are sent to its shard

BLOCK = "block long, doc_id array<long>, n_lines array<int>, n_long array<int>, n_keys long, keys binary, data binary"
ASK = "shard long, block long, keys binary, twice binary"
REPLY = "block long, shard long, suspect binary"
SUSPECT = "lo long, hi long, block long, doc_id long, no_id boolean"
RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string"
NO_ID = -(1 << 63)       # a null id, below every other


def line_keys(text: str, min_chars: int = MIN_CHARS) -> tuple[list[str], list[int], list[bytes]]:
    """The lines of a text, and places and 128-bit hashes of the long ones' keys."""
    lines = text.split("\n")
    places, keys = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(SPACE)
            if len(key) >= min_chars:
                places.append(i)
                keys.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))
    return lines, places, keys


def pack(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per block of about BLOCK_CHARS: ids, numbers of (long) lines, the long lines' hashes, the texts."""

    def run(batches):
        ids, z = exchange.block_ids(), zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts, start, size = b.column("text").to_pylist(), 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                if size < BLOCK_CHARS and end < len(texts):
                    continue
                n_lines, n_long, keys = [], [], []
                for t in texts[start:end]:
                    lines, _, k = line_keys(t, min_chars)
                    n_lines.append(len(lines))
                    n_long.append(len(k))
                    keys += k
                own = pa.array(texts[start:end], pa.large_string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(ids)], pa.int64()),
                     pa.array([b.column("doc_id").slice(start, end - start).to_pylist()], pa.list_(pa.int64())),
                     pa.array([n_lines], pa.list_(pa.int32())), pa.array([n_long], pa.list_(pa.int32())),
                     pa.array([len(set(keys))], pa.int64()), pa.array([b"".join(keys)], pa.binary()),
                     pa.array([z(_stream(own))], pa.binary())],
                    names=["block", "doc_id", "n_lines", "n_long", "n_keys", "keys", "data"])
                start, size = end, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(tidy(run), BLOCK)


def _stream(texts: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _texts(data: bytes) -> list[str]:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all().column("text").to_pylist()


def _hashes(keys: bytes) -> np.ndarray:
    """(lo, hi) of every hash."""
    return np.frombuffer(keys, "<u8").reshape(-1, 2)


def _distinct(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct low words of a block's hashes, whether two of its documents hold one, and each hash's place among them."""
    lo = _hashes(r["keys"])[:, 0]
    own, inverse = np.unique(lo, return_inverse=True)
    doc = np.repeat(np.array([NO_ID if d is None else d for d in r["doc_id"]], dtype=np.int64), r["n_long"])
    least, most = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
    np.minimum.at(least, inverse, doc)
    np.maximum.at(most, inverse, doc)
    return own, least < most, inverse


def _by_shard(lo: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shards of hashes: an order that sorts the hashes by shard, the shards that occur, and their first places."""
    shard = ((lo >> np.uint64(40)) % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    own, first = np.unique(shard[order], return_index=True)
    return order, own, np.append(first, len(lo))


def _ask(packed: DataFrame, n_shards: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                lo, twice, _ = _distinct(r)
                if not len(lo):
                    continue
                order, shards, cuts = _by_shard(lo, n_shards)
                short = lo[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]
                flags = twice[order].astype(np.uint8)
                pieces = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards), pa.array(np.full(len(shards), r["block"], np.int64)),
                     pa.array([short[i:j].tobytes() for i, j in pieces], pa.binary()),
                     pa.array([np.packbits(flags[i:j]).tobytes() for i, j in pieces], pa.binary())],
                    names=["shard", "block", "keys", "twice"])

    return packed.select("block", "doc_id", "n_long", "keys").mapInArrow(tidy(run), ASK)


class TwoFilters:
    """Bloom filters of the hashes seen once or more, and of those seen twice or more."""

    def __init__(self, keys: int, bits_per_key: int = BITS_PER_KEY):
        self.bits = np.uint64(max(64, keys * bits_per_key))
        self.once = np.zeros(int(self.bits), bool)
        self.twice = np.zeros(int(self.bits), bool)

    def places(self, keys: np.ndarray) -> np.ndarray:
        h = (keys ^ (keys >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
        step = ((h >> np.uint64(40)) | np.uint64(1))[:, None]
        return ((h & np.uint64((1 << 40) - 1))[:, None] + step * np.arange(PROBES, dtype=np.uint64)) % self.bits

    def add(self, keys: np.ndarray, twice: np.ndarray) -> None:
        """Distinct keys of one block; ``twice``: the block itself holds them in two documents."""
        at = self.places(keys)
        again = self.once[at].all(axis=1) | twice
        self.twice[at[again].ravel()] = True
        self.once[at.ravel()] = True

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        return self.twice[self.places(keys)].all(axis=1)


def _suspect(asked: DataFrame) -> DataFrame:
    """For each question, one bit a hash: the second filter holds it."""

    def one(t: pa.Table) -> pa.Table:
        keys = []
        for x in t.column("keys").to_pylist():
            wide = np.zeros((len(x) // WIDTH, 8), np.uint8)
            wide[:, :WIDTH] = np.frombuffer(x, np.uint8).reshape(-1, WIDTH)
            keys.append(wide.reshape(-1).view("<u8"))
        filters = TwoFilters(sum(map(len, keys)))
        for k, x in zip(keys, t.column("twice").to_pylist()):
            filters.add(k, np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool))
        return pa.table({"block": t.column("block"), "shard": t.column("shard"),
                         "suspect": pa.array([np.packbits(filters.repeated(k)).tobytes() for k in keys], pa.binary())})

    return asked.groupBy("shard").applyInArrow(tidy_group(one), REPLY)


def _candidates(packed: DataFrame, replies: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """Rows of suspected repeats: for each block and hash the ``min_docs`` largest ids of its documents."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("lo", "hi", "block", "doc_id", "no_id")}
        replied = dict(zip(right.column("shard").to_pylist(), right.column("suspect").to_pylist()))
        for r in left.to_pylist():
            h = _hashes(r["keys"])
            lo, _, inverse = _distinct(r)
            if not len(lo) or not replied:
                continue
            order, shards, cuts = _by_shard(lo, n_shards)
            flags = np.zeros(len(lo), bool)
            for s, i, j in zip(shards.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                flags[order[i:j]] = np.unpackbits(np.frombuffer(replied[s], np.uint8), count=j - i)
            doc = np.repeat(np.array([NO_ID if d is None else d for d in r["doc_id"]], dtype=np.int64), r["n_long"])
            hit = flags[inverse]
            rows = np.stack([h[hit, 0].view(np.int64), h[hit, 1].view(np.int64), doc[hit]], axis=1)
            if not len(rows):
                continue
            rows = np.unique(rows, axis=0)   # by hash, then ascending id
            new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            group = np.cumsum(new) - 1
            last = np.append(np.flatnonzero(new)[1:], len(rows))[group]
            rows = rows[last - np.arange(len(rows)) <= min_docs]
            out["lo"].append(rows[:, 0])
            out["hi"].append(rows[:, 1])
            out["doc_id"].append(rows[:, 2])
            out["block"].append(np.full(len(rows), r["block"], np.int64))
        cat = {k: np.concatenate([np.zeros(0, np.int64), *v]) for k, v in out.items()}
        cat["no_id"] = cat["doc_id"] == NO_ID
        return pa.table({k: pa.array(v) for k, v in cat.items()})

    small = packed.select("block", "doc_id", "n_long", "keys")
    return small.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(tidy_group(one), SUSPECT)


def _drop(packed: DataFrame, verdicts: DataFrame, with_text: bool, min_chars: int) -> DataFrame:
    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = {lo + hi: last for lo, hi, last in zip(_words(right.column("lo")), _words(right.column("hi")), right.column("last").to_pylist())}
        out = defaultdict(list)
        for r in left.to_pylist():
            hashes, at = r["keys"], 0
            for doc, n, n_long, text in zip(r["doc_id"], r["n_lines"], r["n_long"], _texts(r["data"])):
                own = NO_ID if doc is None else doc
                gone = [k for k in range(n_long) if keep.get(hashes[16 * (at + k):16 * (at + k + 1)], own) != own]
                at += n_long
                if gone:
                    lines, places, _ = line_keys(text, min_chars)
                    drop = {places[k] for k in gone}
                    text = "\n".join([x for i, x in enumerate(lines) if i not in drop])
                for k, v in zip(NAMES, (doc, n, len(gone), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
                                        text if with_text else None)):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table({k: pa.array(out[k], t) for k, t in zip(NAMES, kinds)})

    return packed.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(tidy_group(one), RESULT)


NAMES = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"]


def _words(column: pa.ChunkedArray) -> list[bytes]:
    return [x.to_bytes(8, "little", signed=True) for x in column.to_pylist()]


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and ``kept`` (null unless ``with_text``): one row for each input row."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = cut(pack(docs, min_chars), "lines")
    n_keys = packed.agg(F.sum("n_keys")).first()[0] or 0
    n_shards = max(n, -(-n_keys // SHARD_KEYS))
    replies = _suspect(_ask(packed, n_shards))
    rows = cut(_candidates(packed, replies, n_shards, min_docs), "suspects")
    # exact confirmation: distinct documents of each hash, counted in two steps
    found = rows.select("lo", "hi", "doc_id").distinct().groupBy("lo", "hi").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    verdicts = rows.select("lo", "hi", "block").distinct().join(found.select("lo", "hi", "last"), ["lo", "hi"])
    return _drop(packed, verdicts.select("block", "lo", "hi", "last"), with_text, min_chars)
