"""Operator 3: suffix-array dedup with a difference cover, built blockwise.

Every byte covered by a ``length``-byte string that also starts elsewhere is
removed.  Only ties of ``length`` bytes matter, so suffixes need no full order:
two suffixes belong together when their first ``length`` bytes are equal, and
ranks are names of equal strings in place of positions in a sorted order.

``unit="words"`` counts ``length`` in words (runs of other than white space):
what is removed then is every run of ``length`` words that also starts elsewhere,
whatever white space stands between the words, from its first word's first byte
to its last word's last byte.  The steps are the same over names of words in
place of bytes; read "byte" as "word" below where positions are meant.

1. Cover sample.  Positions ``p`` of a text with ``p mod v`` in a difference
   cover D are named by their next ``length - v + 1`` bytes.  For any two
   positions i, j some k < v puts both i + k and j + k in the cover, so a suffix
   that ties with another for ``length`` bytes has a sample among its first v
   positions whose name occurs twice.  All others are settled and never sorted.
2. Suffix buckets.  The remaining suffixes, keyed by the name of their first
   ``length`` bytes, are dealt into buckets of the key space; each bucket is
   sorted by itself, one at a time in a task, and equal neighbours are ties.

Exact copies of a text of ``length`` bytes or more are removed whole (white space
at the ends included), and only one of them sends its suffixes into the buckets.

Scale: samples (about 9 % of positions, 5 bytes each) and unsettled suffixes (12
bytes each) are exchanged as packed arrays; a bucket holds the keys of one part
of the key space, evenly dealt whatever the texts.  Texts are shuffled once as
compressed blocks.  A name that decides has 93 bits: a sum modulo the prime 2**61 - 1,
which two different strings of n bytes share with a probability of at most n / 2**61, and
32 bits of a sum modulo 2**64.  Names of samples are sums modulo 2**64, cut to 5 bytes;
they only choose what is sent to the buckets.

Defined cases: null text is empty; texts shorter than ``length`` keep all their
bytes; an empty table gives an empty result.  There is one result row per input
row, whatever its id (null and repeated ids too); other columns pass through
unchanged with their row when asked for (``others``), clashing ones as ``<name>_in``.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange, residues
from .common import cut, keep_clear, tidy, tidy_group, whole_text

LENGTH = 400
BLOCK_BYTES = 3_000_000
WORD_BLOCK_BYTES = 1_500_000   # words take arrays for their bytes and for themselves
SAMPLE_WIDTH = 5   # bytes of a sample's name that are sent; a false tie only sends a suffix to the buckets
PLAIN, COPY, OPEN, COPY_OPEN = 0, 1, 2, 3
BLOCK = "block long, doc_id array<long>, size array<int>, hash array<binary>, data binary, others binary"
PENDING = ("block long, doc_id array<long>, size array<int>, held array<boolean>, state array<array<byte>>, units array<array<int>>, "
           "sha array<string>, starts array<binary>, data binary, others binary")
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def difference_cover(r: int = 2) -> tuple[int, np.ndarray]:
    """Period ``24 r^2 + 36 r + 13`` and a cover of ``6 r + 4`` residues (Colbourn and Ling's construction)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.cumsum([0, *steps])


def cover_of(length: int) -> tuple[int, np.ndarray]:
    """The largest of the covers whose period is at most half of ``length``; every position where none is."""
    for r in (2, 1, 0):
        v, cover = difference_cover(r)
        if 2 * v <= length:
            return v, cover
    return 1, np.zeros(1, np.int64)


_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse (mod 2**64), at least ``n``."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
    return _POWERS


class Windows:
    """Fingerprints of windows of an array of bytes, or of names (64 bit) of words."""

    def __init__(self, x: np.ndarray):
        p, self.inverse = _powers(len(x) + 1)
        terms = _TABLE[x] if x.dtype == np.uint8 else x.copy()
        terms *= p[:len(x)]
        self.h = np.zeros(len(x) + 1, np.uint64)   # summed in place: a block's arrays are eight times its bytes each
        np.cumsum(terms, out=self.h[1:])

    def at(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        k = (self.h[start + length] - self.h[start]) * self.inverse[start]
        k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return k ^ (k >> np.uint64(32))


_PRIME_BASE = 0x17A3C9E45D2B8F61
_TABLE_P: list[np.ndarray] = []


class Names:
    """Names that decide: for windows of an array of bytes, or of names (64 bit) of words, two words each.

    The first is the residue of their sum modulo 2**61 - 1, the second the high half of their fingerprint.
    """

    def __init__(self, x: np.ndarray, windows: Windows):
        n = len(x) + 1
        if not _TABLE_P or len(_TABLE_P[0]) < n:
            _TABLE_P[:] = [residues.powers(b, n) for b in (_PRIME_BASE % residues.PRIME, pow(_PRIME_BASE, -1, residues.PRIME))]
        up, self.down = _TABLE_P
        x = x.astype(np.uint64) + np.uint64(1) if x.dtype == np.uint8 else x % np.uint64(residues.PRIME)
        self.sums = np.concatenate([np.zeros(1, np.uint64), residues.running(residues.mulmod(x, up[:len(x)]), 0)])
        self.windows = windows

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        first = residues.mulmod(residues.minus(self.sums[start + length], self.sums[start]), self.down[start])
        return np.stack([first, self.windows.at(start, length) >> np.uint64(32)], axis=1)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Units:
    """The texts of a block as bytes or as words: how many each has, fingerprints of windows, and their bytes."""

    def __init__(self, x: np.ndarray, size: np.ndarray, unit: str):
        begin = np.cumsum(size) - size
        if unit == "bytes":
            self.n, self.first, self._x = size, None, x
        else:
            solid, full = ~_SPACE[x], size > 0
            before, after = np.append(False, solid[:-1])[:len(x)], np.append(solid[1:], False)[:len(x)]
            before[begin[full]] = False   # a word ends with its text
            after[(begin + size)[full] - 1] = False
            self.first, self.last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
            self.n = np.searchsorted(self.first, begin + size) - np.searchsorted(self.first, begin)
            self._x = Windows(x).at(self.first, self.last - self.first)
        self.begin, self._windows = np.cumsum(self.n) - self.n, None

    def __len__(self) -> int:
        return len(self._x)

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        self._windows = self._windows or Windows(self._x)
        return self._windows.at(start, length)

    def distinct(self, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of windows, each window's place among them, and how often each occurs."""
        self._windows = self._windows or Windows(self._x)
        names = Names(self._x, self._windows).at(start, length)
        order = exchange.pairs_in_order(names)
        new = np.append(True, (names[order[1:]] != names[order[:-1]]).any(axis=1))
        inverse = np.empty(len(start), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return names[order[new]], inverse, np.bincount(inverse)

    def bytes_of(self, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First byte of every window, and the one after its last."""
        return (start, start + length) if self.first is None else (self.first[start], self.last[start + length - 1])


def _packed_rows(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(_open(data).tobytes()).read_all()


def pack(docs: DataFrame, others: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of about ``block_bytes``: ids, sizes, hashes, the compressed bytes of its texts and its ``others``."""

    def run(batches):
        ids, zip_ = exchange.block_ids(), zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            start, size = 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                if size < block_bytes and end < len(texts):
                    continue
                own = texts[start:end]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(ids)], pa.int64()), pa.array([b.column("doc_id").slice(start, end - start).to_pylist()], pa.list_(pa.int64())),
                     pa.array([[len(t) for t in own]], pa.list_(pa.int32())),
                     pa.array([[hashlib.blake2b(t, digest_size=16).digest() for t in own]], pa.list_(pa.binary())),
                     pa.array([zip_.compress(b"".join(own))], pa.binary()),
                     pa.array([_packed_rows(b.select(others).slice(start, end - start)) if others else b""], pa.binary())],
                    names=["block", "doc_id", "size", "hash", "data", "others"])
                start, size = end, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), *others).mapInArrow(tidy(run), BLOCK)


def _open(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data) if data else b"", np.uint8)


def _samples(units: Units, length: int, v: int, cover: np.ndarray) -> np.ndarray:
    """Positions in a block of the cover samples of its texts; texts shorter than ``length`` have none."""
    span = length - v + 1
    out = [s + p[p <= n - span] for s, n in zip(units.begin, units.n) if n >= length
           for p in ((np.arange(0, n, v)[:, None] + cover[None, :]).ravel(),)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _shifted(b: pa.RecordBatch, by: int) -> pa.RecordBatch:
    """Request rows with their part moved: every search has its own parts."""
    i = b.schema.get_field_index("part")
    return b.set_column(i, "part", pa.array(b.column(i).to_numpy() + by))


def _ask_samples(packed: DataFrame, n_parts: int, searches: list[tuple[int, str]]) -> DataFrame:
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                x, size = _open(r["data"]), np.array(r["size"], dtype=np.int64)
                for k, (length, unit) in enumerate(searches):
                    v, cover = cover_of(length)
                    units = Units(x, size, unit)
                    at = _samples(units, length, v, cover)
                    if len(at):
                        keys, counts = np.unique(units.at(at, length - v + 1), return_counts=True)
                        yield _shifted(exchange.ask_repeated(r["block"], keys, counts, n_parts, SAMPLE_WIDTH), k * n_parts)

    return packed.mapInArrow(tidy(run), exchange.REQUEST)


def _replies_of(t: pa.Table, k: int, n_parts: int) -> pa.Table:
    """The reply rows of the k-th search, with their parts from 0 on."""
    part = t.column("part").to_numpy()
    own = t.filter(pa.array((part >= k * n_parts) & (part < (k + 1) * n_parts)))
    return own.set_column(own.schema.get_field_index("part"), "part", pa.array(own.column("part").to_numpy() - k * n_parts))


def _copies(packed: DataFrame) -> DataFrame:
    """Reply rows (part -1) that name a block's exact copies: ``place,place,...:first`` per text, joined by ``;``.

    A block sends one row per distinct text; ``first`` is 1 where the least of its places is the first copy of all.
    """
    def run(batches):
        for b in batches:
            for block, h in zip(b.column("block").to_pylist(), b.column("hash").to_pylist()):
                places: dict[bytes, list[int]] = {}
                for k, x in enumerate(h):
                    places.setdefault(x, []).append(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(places), pa.int64()), pa.array(list(places), pa.binary()), pa.array([len(p) for p in places.values()], pa.int64()),
                     pa.array([",".join(map(str, p)) for p in places.values()])], names=["block", "hash", "n", "places"])

    d = packed.mapInArrow(tidy(run), "block long, hash binary, n long, places string")
    g = d.groupBy("hash").agg(F.sum("n").alias("m"), F.min("block").alias("first")).where("m > 1")
    d = d.join(g, "hash").withColumn("is_first", F.col("block") == F.col("first"))
    item = F.concat_ws(":", F.col("places"), F.col("is_first").cast("int").cast("string"))
    return d.groupBy("block").agg(F.concat_ws(";", F.collect_list(item)).cast("binary").alias("totals")).select(
        "block", F.lit(-1).cast("long").alias("part"), "totals")


def _copy_places(totals: list[bytes]) -> dict[int, bool]:
    """Place of every copy in a block -> whether it is the first of all."""
    out = {}
    for item in (x for t in totals if t for x in t.decode().split(";")):
        places, first = item.split(":")
        places = [int(p) for p in places.split(",")]
        out |= {p: first == "1" and p == places[0] for p in places}
    return out


def _settle(packed: DataFrame, replies: DataFrame, n_parts: int, searches: list[tuple[int, str]], with_text: bool) -> DataFrame:
    """Blocks with every text's state in each search; texts open in any keep their bytes, and the suffixes still to be sorted."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {k: [] for k in ("block", "doc_id", "size", "held", "state", "units", "sha", "starts", "data", "others")}
        is_copy = np.array(right.column("part").to_pylist(), dtype=np.int64) == -1
        copy = _copy_places(right.filter(pa.array(is_copy)).column("totals").to_pylist())
        right = right.filter(pa.array(~is_copy))
        z = zstandard.ZstdCompressor(level=1).compress
        for r in left.to_pylist():
            size = np.array(r["size"], dtype=np.int64)
            x, begin = _open(r["data"]), np.cumsum(size) - size
            states, unit_counts, found = [], [], []
            for k, (length, unit) in enumerate(searches):
                v, cover = cover_of(length)
                units = Units(x, size, unit)
                at = _samples(units, length, v, cover)
                twice = np.zeros(len(units) + v + 1, np.int32)
                if len(at):
                    keys, inverse = np.unique(units.at(at, length - v + 1), return_inverse=True)
                    twice[at] = exchange.collect_replies(_replies_of(right, k, n_parts), keys, n_parts, "u1")[inverse]
                count = np.concatenate([[0], np.cumsum(twice)])
                state, starts = [], []
                for place, (s, n) in enumerate(zip(units.begin.tolist(), units.n.tolist())):
                    # only suffixes with a repeated sample among their first v positions can tie with another
                    i = np.arange(s, s + max(0, n - length + 1))
                    here = np.flatnonzero(count[i + v] > count[i]) if len(i) else i
                    if place in copy and n >= length:
                        state.append(COPY_OPEN if copy[place] else COPY)
                        here = here if copy[place] else here[:0]
                    else:
                        state.append(OPEN if len(here) else PLAIN)
                    starts.append(here)
                states.append(state)
                unit_counts.append(units.n.tolist())
                found.append(starts)
            held = [with_text or any(st[place] in (OPEN, COPY_OPEN) for st in states) for place in range(len(size))]
            packed_starts = []
            for n_units, starts in zip(unit_counts, found):
                first = np.cumsum([0, *[n if h else 0 for n, h in zip(n_units, held)]])
                packed_starts.append(z(_runs(np.concatenate([np.zeros(0, np.int64), *[here + f for here, f, h in zip(starts, first, held) if h]])).astype("<i8").tobytes()))
            own = [x[b:b + m] for b, m in zip(begin.tolist(), size.tolist())]
            rows["block"].append(r["block"])
            rows["doc_id"].append(r["doc_id"])
            rows["size"].append(r["size"])
            rows["held"].append(held)
            rows["state"].append(states)
            rows["units"].append(unit_counts)
            rows["sha"].append([hashlib.sha256(t).hexdigest() if st == PLAIN and not with_text else None for t, st in zip(own, states[0])])
            rows["starts"].append(packed_starts)
            rows["data"].append(z(b"".join(t.tobytes() for t, h in zip(own, held) if h)))
            rows["others"].append(r["others"])
        kinds = dict(block=pa.int64(), doc_id=pa.list_(pa.int64()), size=pa.list_(pa.int32()), held=pa.list_(pa.bool_()),
                     state=pa.list_(pa.list_(pa.int8())), units=pa.list_(pa.list_(pa.int32())), sha=pa.list_(pa.string()),
                     starts=pa.list_(pa.binary()), data=pa.binary(), others=pa.binary())
        return pa.table({k: pa.array(x, kinds[k]) for k, x in rows.items()})

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(tidy_group(one), PENDING)


def _runs(i: np.ndarray) -> np.ndarray:
    """Ascending integers as (first, last + 1) of their runs."""
    if not len(i):
        return np.zeros((0, 2), np.int64)
    cut_ = np.flatnonzero(np.diff(i) != 1) + 1
    return np.stack([i[np.concatenate([[0], cut_])], i[np.concatenate([cut_ - 1, [len(i) - 1]])] + 1], axis=1)


def _starts(data: bytes) -> np.ndarray:
    runs = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8").reshape(-1, 2)
    return np.concatenate([np.zeros(0, np.int64), *[np.arange(a, b) for a, b in runs.tolist()]])


def _held(r: dict) -> np.ndarray:
    """Sizes of the texts whose bytes a pending block has."""
    return np.array([n for n, h in zip(r["size"], r["held"]) if h], dtype=np.int64)


def _ask_suffixes(pending: DataFrame, n_parts: int, searches: list[tuple[int, str]], k: int) -> DataFrame:
    """Request rows of the k-th search."""
    length, unit = searches[k]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                at = _starts(r["starts"][k])
                if len(at):
                    keys, _, counts = Units(_open(r["data"]), _held(r), unit).distinct(at, length)
                    yield _shifted(exchange.ask_repeated_pairs(r["block"], keys, counts, n_parts), k * n_parts)

    return pending.select("block", "size", "held", "starts", "data").mapInArrow(tidy(run), exchange.REQUEST)


def _remove(pending: DataFrame, replies: DataFrame, n_parts: int, searches: list[tuple[int, str]], with_text: bool,
            others: T.StructType) -> DataFrame:
    """RESULT of the first search, ``n_units<k>`` and ``n_spans<k>`` of the k-th (units and runs removed), and ``others``."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        more, out = [], {k: [] for k in names}
        for r in left.to_pylist():
            if others.names:
                more.append(_rows(r["others"]))
            x, size = _open(r["data"]), _held(r)
            begin = np.cumsum(size) - size
            found = []   # per search: bytes that go, units that go (running), and each held text's first unit
            for k, (length, unit) in enumerate(searches):
                units, at = Units(x, size, unit), _starts(r["starts"][k])
                edge = np.zeros(len(x) + 1, np.int32)
                if len(at):
                    keys, inverse, _ = units.distinct(at, length)
                    hit = at[exchange.collect_pairs(_replies_of(right, k, n_parts), keys, n_parts)[inverse]]
                    first, end = units.bytes_of(hit, length)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, end, -1)
                gone = np.cumsum(edge[:-1]) > 0
                found.append((gone, np.concatenate([[0], np.cumsum(gone if units.first is None else gone[units.first])]), units))
            at_held = -1
            for place, (i, n, sha, h) in enumerate(zip(r["doc_id"], r["size"], r["sha"], r["held"])):
                at_held += h
                b = int(begin[at_held]) if h else 0
                row = {"doc_id": i, "n_bytes": n}
                for k, (gone, lost, units) in enumerate(found):
                    state, cover = r["state"][k][place], gone[b:b + n] if h else gone[:0]
                    if state in (COPY, COPY_OPEN):
                        removed, spans, n_units = n, 1, r["units"][k][place]
                    elif h:
                        u, m = int(units.begin[at_held]), int(units.n[at_held])
                        removed, spans = int(cover.sum()), int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
                        n_units = int(lost[u + m] - lost[u])
                    else:
                        removed = spans = n_units = 0
                    row |= {f"n_units{k}": n_units, f"n_spans{k}": spans}
                    if not k:
                        own = x[b:b + n] if h else x[:0]
                        kept = b"" if state in (COPY, COPY_OPEN) else own[~cover].tobytes()
                        plain = state == PLAIN and sha is not None
                        row |= {"n_removed": removed, "n_spans": spans, "kept_sha256": sha if plain else hashlib.sha256(kept).hexdigest(),
                                "kept": kept if with_text else None}
                for c in names:
                    out[c].append(row[c])
        result = pa.table({c: pa.array(out[c], pa.string() if c == "kept_sha256" else pa.binary() if c == "kept" else pa.int64()) for c in names})
        if others.names:
            more = pa.concat_tables(more)
            for c in others.names:
                result = result.append_column(c, more.column(c))
        return result

    per_search = ", ".join(f"n_units{k} long, n_spans{k} long" for k in range(len(searches)))
    own = T.StructType.fromDDL(RESULT + ", " + per_search)
    names = own.names
    return pending.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(tidy_group(one), T.StructType([*own.fields, *others.fields]))


def _search(docs: DataFrame, searches: list[tuple[int, str]], with_text: bool, others: list[str]) -> DataFrame:
    """All searches over the same blocks: one shuffle of the texts, one exchange of samples, one of suffixes."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_parts = 4 * n
    taken = ["doc_id", "text", *T.StructType.fromDDL(RESULT).names, *[f"n_{c}{k}" for c in ("units", "spans") for k in range(len(searches))]]
    carried = keep_clear(docs.select(*[F.col(f"`{c}`") for c in others]), taken)
    docs = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for c, k in zip(others, carried.columns)])
    # all uses below read whole rows of the exchange, so that Spark reuses it
    size = WORD_BLOCK_BYTES if any(unit == "words" for _, unit in searches) else BLOCK_BYTES
    packed = pack(docs, carried.columns, size).repartition(n, "block")
    replies = exchange.repeated(_ask_samples(packed, n_parts, searches), SAMPLE_WIDTH).unionByName(_copies(packed))
    pending = cut(_settle(packed, replies, n_parts, searches, with_text), "pending")
    # one search after the other: the names it sent are gone before the next one sends its own
    ties = [cut(exchange.repeated_pairs(_ask_suffixes(pending, n_parts, searches, k)), f"ties{k}") for k in range(len(searches))]
    ties = reduce(DataFrame.unionByName, ties)
    return _remove(pending, ties, n_parts, searches, with_text, carried.schema)


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = True, unit: str = "bytes",
          others: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and ``kept``: the remaining bytes.

    ``length`` counts ``unit``s: bytes or words.  ``with_text=False`` leaves ``kept`` null and carries the bytes of open texts only.
    ``others``: input columns that come out with their row.
    """
    return _search(docs, [(length, unit)], with_text, others or []).drop("n_units0", "n_spans0")


def repeats(docs: DataFrame, n_bytes: int = LENGTH, n_words: int = 51) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``dedup`` with ``n_bytes`` bytes, and beside them how many words
    stand in runs of ``n_words`` words that also start elsewhere (n_repeat_words), and in how many maximal runs (n_repeat_runs).
    """
    d = _search(docs.select("doc_id", "text"), [(n_bytes, "bytes"), (n_words, "words")], False, [])
    return d.drop("kept", "n_units0", "n_spans0").withColumnsRenamed({"n_units1": "n_repeat_words", "n_spans1": "n_repeat_runs"})
