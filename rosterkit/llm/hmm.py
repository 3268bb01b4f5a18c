"""Operator 8: hidden Markov language model.

Words are emitted through classes: a word as frequent as 1 in FREQUENT training
tokens is a class of its own (there can be at most FREQUENT of these), all other
words share classes by spelling (a hash of their first and last letters).  A
state emits a class, a class emits a word by its training count, so

    P(text) = sum over state paths of  prod  A[s', s] * B[s, class] * P(word | class)

with P(word | class) = (c + 1) / (tokens of the class + its distinct words + 1)
for a shared class (c = 0: a new word) and 1 for a frequent word.  A and B (and
the start law) are trained by Baum-Welch: every partition runs forward-backward
over its texts and emits expected counts, which are added up over partitions;
the scaled forward recursion then gives the exact likelihood of each text.  The
end of the text is a token like the words.

The first parameters come from counts of adjacent classes over every training text:
classes are dealt into GROUPS groups (the most frequent alone, the others by number), pairs
of groups are counted in one pass, and START_ROUNDS rounds of expectation and maximisation on
the table of pairs, GROUPS x GROUPS at any input size, give the first transitions and
emissions.  Whole numbers are added up, so files and partitions do not matter.
All rounds after that, and all counts, cover every training text too.

Scale: word counts travel as packed arrays (``exchange``): two shuffles of the
blocks' vocabularies, none of the tokens.  What tasks get by closure is bounded:
STATES * (FREQUENT + SHARED + 1) numbers.  Expected counts are pre-added in the
task and summed by class range.

Defined cases: null text is empty (one token: the end); with no training text
every count is 0 and the scores are those of the smoothing alone; repeated rows
are counted and scored as rows; extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import cut, id_crc, tidy, tidy_group, whole_text

STATES = 6
FREQUENT = 16_384     # a frequent word is at least one in so many training tokens
SHARED = 4_096        # classes of the other words
ROUNDS = 2            # Baum-Welch rounds over all training texts
GROUPS = 2_048        # groups of classes whose pairs are counted for the first parameters
ALONE = 2_000         # of these, for the most frequent classes, one each
START_ROUNDS = 150
PRIOR = 0.5           # pseudo-tokens per state, spread like the classes' overall shares
BLOCK_CHARS = 4_000_000
BATCH_TOKENS = 400_000
END = np.uint64(0)    # key of the end token (no word hashes to it but by chance)
BLOCK = ("block long, doc_id array<long>, held array<boolean>, size array<int>, train long, codes binary, keys binary, "
         "shared binary")
SEQ = ("block long, doc_id array<long>, held array<boolean>, size array<int>, known array<int>, base array<double>, "
       "inner array<double>, classes binary")


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unzip(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def spelling_class(word: bytes) -> int:
    """Shared class of a word: a hash of its first two and last two bytes."""
    return xxhash.xxh32_intdigest(word[:2] + b"\0" + word[-2:]) % SHARED


def pack(docs: DataFrame) -> DataFrame:
    """Blocks: texts as codes into the block's vocabulary (keys, shared classes); documents' sizes count the end."""

    def run(batches):
        ids = exchange.block_ids()
        for b in batches:
            texts, held = b.column("text").to_pylist(), b.column("held").to_pylist()
            start, size = 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                if size < BLOCK_CHARS and end < len(texts):
                    continue
                tokens, sizes = [], []
                for t in texts[start:end]:
                    w = t.encode("utf-8", "surrogatepass").lower().split()
                    w.append(b"")           # the end
                    tokens += w
                    sizes.append(len(w))
                coded = pa.array(tokens, pa.binary()).dictionary_encode()
                words = coded.dictionary.to_pylist()
                keys = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in words], dtype=np.uint64)
                shared = np.array([spelling_class(w) for w in words], dtype=np.uint16)
                own = held[start:end]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(ids)], pa.int64()), pa.array([b.column("doc_id").slice(start, end - start).to_pylist()], pa.list_(pa.int64())),
                     pa.array([own], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())),
                     pa.array([sum(n for n, h in zip(sizes, own) if not h)], pa.int64()),
                     *[pa.array([_zip(x)], pa.binary()) for x in (coded.indices.to_numpy().astype("<i4"), keys, shared)]],
                    names=["block", "doc_id", "held", "size", "train", "codes", "keys", "shared"])
                start, size = end, 0

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), (id_crc() % 7 == 2).alias("held"))
    return d.mapInArrow(tidy(run), BLOCK)


def _block_counts(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, keys and training counts of a block's vocabulary."""
    codes, keys = _unzip(r["codes"], "<i4"), _unzip(r["keys"], "<u8")
    train = ~np.repeat(np.array(r["held"], dtype=bool), np.array(r["size"], dtype=np.int64))
    return codes, keys, np.bincount(codes[train], minlength=len(keys))


def _ask(packed: DataFrame, n_parts: int) -> DataFrame:
    """Requests: a block's keys with their training counts; the key carries its shared class along in ``counts``."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                _, keys, counts = _block_counts(r)
                shared = _unzip(r["shared"], "<u2")
                order = np.argsort(keys)
                rows = exchange.requests(r["block"], keys, counts, n_parts)
                # the classes in the same order as the request's keys
                part = exchange.parts_of(keys[order], n_parts)
                classes = shared[order][np.argsort(part, kind="stable")]
                ends = np.cumsum([len(x) // 8 for x in rows.column("keys").to_pylist()])
                cuts = [0, *ends.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array([classes[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())],
                    names=[*rows.schema.names, "shared"])

    return packed.select("block", "held", "size", "codes", "keys", "shared").mapInArrow(tidy(run), exchange.REQUEST + ", shared binary")


def _vocabulary(asked: DataFrame, threshold: float) -> DataFrame:
    """Replies for the blocks, and per part (block -1): V, the frequent words and the shared classes' totals."""

    def add(t: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x, "<u8") for x in t.column("keys").to_pylist()]
        keys, first, inverse = np.unique(np.concatenate(raw), return_index=True, return_inverse=True)
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("counts").to_pylist()])
        shared = np.concatenate([np.frombuffer(x, "<u2") for x in t.column("shared").to_pylist()])[first]
        total = np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)
        own = (total >= threshold) & (total > 0) | (keys == END)
        ends = np.cumsum([len(x) for x in raw])
        spread = total[inverse].astype("<u4")
        rest = ~own & (total > 0)
        n = np.bincount(shared[rest], weights=total[rest], minlength=SHARED).astype("<i8")
        v = np.bincount(shared[rest], minlength=SHARED).astype("<i8")
        size = len(raw)
        return pa.table({
            "block": pa.concat_arrays([*t.column("block").chunks, pa.array([-1], pa.int64())]),
            "part": pa.concat_arrays([*t.column("part").chunks, t.column("part").chunk(0).slice(0, 1)]),
            "totals": pa.array([spread[e - len(x):e].tobytes() for e, x in zip(ends, raw)] + [b""], pa.binary()),
            "v": pa.array([None] * size + [int((total > 0).sum())], pa.int64()),
            "own": pa.array([None] * size + [keys[own].tobytes()], pa.binary()),
            "own_n": pa.array([None] * size + [total[own].astype("<i8").tobytes()], pa.binary()),
            "class_n": pa.array([None] * size + [_zip(n)], pa.binary()),
            "class_v": pa.array([None] * size + [_zip(v)], pa.binary())})

    return asked.groupBy("part").applyInArrow(tidy_group(add), exchange.REPLY + ", v long, own binary, own_n binary, class_n binary, class_v binary")


class Vocabulary:
    """Bounded facts of the training counts: N, V, frequent words (keys, sorted) and the shared classes' totals."""

    def __init__(self, n: int, rows):
        self.n, self.v = n, 0
        self.class_n, self.class_v = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for r in rows:   # one at a time
            self.v += r["v"]
            self.class_n += _unzip(r["class_n"], "<i8")
            self.class_v += _unzip(r["class_v"], "<i8")
            keys.append(np.frombuffer(r["own"], "<u8"))
            counts.append(np.frombuffer(r["own_n"], "<i8"))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        if END not in keys:
            keys, counts = np.append(keys, END), np.append(counts, 0)
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    @property
    def n_classes(self) -> int:
        return SHARED + len(self.keys)

    def classes(self, keys: np.ndarray, shared: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, SHARED + i, shared).astype(np.int64)

    def inner(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | class)."""
        s = np.minimum(classes, SHARED - 1)
        p = (counts + 1) / (self.class_n[s] + self.class_v[s] + 1)
        return np.where(classes < SHARED, np.log10(p), 0.0)

    def shares(self) -> np.ndarray:
        """Share of every class among training tokens, never 0."""
        x = np.concatenate([self.class_n + 1.0, self.counts + 1.0])
        return x / x.sum()


def _sequences(packed: DataFrame, replies: DataFrame, vocabulary: Vocabulary, n_parts: int) -> DataFrame:
    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("block", "doc_id", "held", "size", "known", "base", "inner", "classes")}
        for r in left.to_pylist():
            codes, keys, _ = _block_counts(r)
            c = exchange.collect_replies(right, keys, n_parts)
            classes = vocabulary.classes(keys, _unzip(r["shared"], "<u2"))
            base = np.log10(c + 1.0) - math.log10(vocabulary.n + vocabulary.v + 1)
            begin = np.cumsum([0, *r["size"]])[:-1]
            add = lambda x: np.add.reduceat(x, begin).tolist()
            out["known"].append(add((c > 0).astype(np.int64)[codes]))
            out["base"].append(add(base[codes]))
            out["inner"].append(add(vocabulary.inner(classes, c)[codes]))
            out["classes"].append(_zip(classes[codes].astype("<u2")))
            for k in ("block", "doc_id", "held", "size"):
                out[k].append(r[k])
        kinds = dict(block=pa.int64(), doc_id=pa.list_(pa.int64()), held=pa.list_(pa.bool_()), size=pa.list_(pa.int32()),
                     known=pa.list_(pa.int32()), base=pa.list_(pa.float64()), inner=pa.list_(pa.float64()), classes=pa.binary())
        return pa.table({k: pa.array(x, kinds[k]) for k, x in out.items()})

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(tidy_group(one), SEQ)


class Model:
    """Start law, transitions and class emissions (rows: classes)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, shares: np.ndarray, states: int = STATES, seed: int = 5) -> Model:
        """States that keep to themselves, with emissions near the overall shares."""
        rng = np.random.default_rng(seed)
        emit = shares[:, None] * rng.uniform(0.5, 1.5, (len(shares), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def refit(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray) -> Model:
        """Maximisation step: expected counts plus the prior."""
        emit, move, start = emit + PRIOR * shares[:, None], move + 0.1, start + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _by_time(sizes: np.ndarray):
    """Order of the texts (longest first), and for each time the number of texts that still run."""
    order = np.argsort(-sizes, kind="stable")
    running = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left") if len(sizes) else np.zeros(0, np.int64)
    return order, running


def forward(model: Model, classes: np.ndarray, sizes: np.ndarray, keep: bool = False):
    """log10 likelihood of every text by the scaled forward recursion; with ``keep`` also the scaled alphas by time."""
    order, running = _by_time(sizes)
    at = (np.cumsum(sizes) - sizes)[order]
    total, alphas, alpha = np.zeros(len(sizes)), [], None
    for t, m in enumerate(running.tolist()):
        e = model.emit[classes[at[:m] + t]]
        alpha = e * model.start if t == 0 else (alpha[:m] @ model.move) * e
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        total[:m] += np.log10(scale)
        if keep:
            alphas.append((alpha, scale))
    out = np.empty(len(sizes))
    out[order] = total
    return (out, alphas, at, running) if keep else out


def expected(model: Model, classes: np.ndarray, sizes: np.ndarray):
    """Baum-Welch expected counts (start, move, emit) of some texts."""
    _, alphas, at, running = forward(model, classes, sizes, keep=True)
    states = len(model.start)
    move, emit = np.zeros((states, states)), np.zeros_like(model.emit)
    gammas, where = [], []
    beta, start, m_next = None, np.zeros(states), 0
    for t in range(len(running) - 1, -1, -1):
        m = int(running[t])
        alpha, _ = alphas[t]
        b = np.ones((m, states))
        if m_next:
            e = model.emit[classes[at[:m_next] + t + 1]] * beta / alphas[t + 1][1][:, None]
            b[:m_next] = e @ model.move.T
            move += alpha[:m_next].T @ e
        g = alpha * b
        gammas.append(g)
        where.append(classes[at[:m] + t])
        beta, m_next = b, m
        if t == 0:
            start = g.sum(0)
    if gammas:
        g, where = np.concatenate(gammas), np.concatenate(where)
        for s in range(states):
            emit[:, s] = np.bincount(where, weights=g[:, s], minlength=len(emit))
    return start, move * model.move, emit


def _batches(classes: np.ndarray, sizes: np.ndarray):
    """Ranges of texts with about BATCH_TOKENS tokens."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + BATCH_TOKENS, side="right")))
        yield i, j, classes[done:ends[j - 1]].astype(np.int64), sizes[i:j]
        i = j


def _training(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Classes and sizes of a block's training texts."""
    classes, sizes, held = _unzip(r["classes"], "<u2"), np.array(r["size"], dtype=np.int64), np.array(r["held"], dtype=bool)
    return classes[~np.repeat(held, sizes)], sizes[~held]


def _groups(shares: np.ndarray) -> np.ndarray:
    """The group of every class: the ALONE most frequent ones by themselves, the others by their number."""
    alone = np.argsort(-shares, kind="stable")[:ALONE]
    out = ALONE + np.arange(len(shares)) % (GROUPS - ALONE)
    out[alone] = np.arange(len(alone))
    return out


def _pairs(seqs: DataFrame, groups: np.ndarray) -> np.ndarray:
    """How often each pair of groups is adjacent in the training texts."""
    size = GROUPS * 32   # pairs in one row of counts

    def run(batches):
        n = np.zeros(GROUPS * GROUPS, np.int64)
        for b in batches:
            for r in b.to_pylist():
                c, sizes = _training(r)
                g = groups[c]
                inside = np.ones(len(g), bool)
                inside[np.cumsum(sizes) - 1] = False     # the last token of a text has no next one
                i = np.flatnonzero(inside)
                n += np.bincount(g[i] * GROUPS + g[i + 1], minlength=len(n))
        if n.any():
            k = len(n) // size
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int64()), pa.array([_zip(x) for x in n.reshape(k, size)], pa.binary())],
                                             names=["range", "counts"])

    def add(t: pa.Table) -> pa.Table:
        x = np.zeros(size, np.int64)
        for v in t.column("counts").to_pylist():
            x += _unzip(v, "<i8")
        return pa.table({"range": t.column("range").slice(0, 1), "counts": pa.array([_zip(x)], pa.binary())})

    got = seqs.select("held", "size", "classes").mapInArrow(tidy(run), "range long, counts binary")
    out = np.zeros((GROUPS * GROUPS // size, size), np.int64)
    for r in got.groupBy("range").applyInArrow(tidy_group(add), "range long, counts binary").toLocalIterator():   # bounded: GROUPS x GROUPS
        out[r["range"]] = _unzip(r["counts"], "<i8")
    return out.reshape(GROUPS, GROUPS)


def first_model(pairs: np.ndarray, shares: np.ndarray, groups: np.ndarray, states: int = STATES, seed: int = 5) -> Model:
    """Transitions and emissions that explain the table of adjacent groups, by expectation and maximisation."""
    share = np.bincount(groups, weights=shares, minlength=len(pairs))
    model = Model.first(share, states, seed)
    emit, both = model.emit, model.start[:, None] * model.move
    pairs = pairs.astype(np.float32)
    for _ in range(START_ROUNDS if pairs.any() else 0):
        r = pairs / np.maximum((emit @ both).astype(np.float32) @ emit.T.astype(np.float32), 1e-30)
        first, second = emit * (r @ emit @ both.T), emit * (r.T @ emit @ both)
        both = both * (emit.T @ r @ emit) + 0.1
        both /= both.sum()
        emit = first + second + PRIOR * share[:, None]
        emit /= emit.sum(0)
    wide = emit[groups] * (shares / np.maximum(share[groups], 1e-300))[:, None]
    return Model(both.sum(1), both / both.sum(1, keepdims=True), wide / wide.sum(0))


def _round(seqs: DataFrame, model: Model, shares: np.ndarray) -> Model:
    """One Baum-Welch round over all training texts."""
    size = 1024   # classes in one row of counts

    def run(batches):
        start, move, emit = 0, 0, 0
        for b in batches:
            for r in b.to_pylist():
                c, s = _training(r)
                for _, _, own, sizes in _batches(c, s):
                    x = expected(model, own, sizes)
                    start, move, emit = start + x[0], move + x[1], emit + x[2]
        if isinstance(emit, np.ndarray):
            rows = [(-1, np.concatenate([start, move.ravel()]))]
            rows += [(k, emit[k * size:(k + 1) * size].ravel()) for k in range(-(-len(emit) // size))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                                             names=["range", "counts"])

    def add(t: pa.Table) -> pa.Table:
        x = sum(np.frombuffer(v, "<f8") for v in t.column("counts").to_pylist())
        return pa.table({"range": t.column("range").slice(0, 1), "counts": pa.array([x.tobytes()], pa.binary())})

    got = seqs.select("held", "size", "classes").mapInArrow(tidy(run), "range long, counts binary")
    got = {r["range"]: np.frombuffer(r["counts"], "<f8") for r in got.groupBy("range").applyInArrow(tidy_group(add), "range long, counts binary").collect()}
    states = len(model.start)
    if -1 not in got:
        return model
    emit = np.concatenate([got[k] for k in sorted(got) if k >= 0]).reshape(-1, states)
    return Model.refit(got[-1][:states], got[-1][states:].reshape(states, states), emit, shares)


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Vocabulary, Model]:
    """(sequences, vocabulary, model): sequences hold every text as classes, with its base score and inner part."""
    spark = docs.sparkSession
    n_parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = cut(pack(docs), "packed")
    n = int(packed.agg(F.sum("train")).first()[0] or 0)
    replies = cut(_vocabulary(_ask(packed, n_parts), n / FREQUENT), "vocabulary")
    facts = replies.where("block = -1").select("v", "own", "own_n", "class_n", "class_v")
    # one bounded row per part of the key space, added up one at a time
    vocabulary = Vocabulary(n, facts.toLocalIterator())
    seqs = cut(_sequences(packed, replies.where("block >= 0").select("block", "part", "totals"), vocabulary, n_parts), "sequences")
    shares = vocabulary.shares()
    groups = _groups(shares)
    model = first_model(_pairs(seqs, groups), shares, groups)
    for _ in range(rounds):
        model = _round(seqs, model, shares)
    return seqs, vocabulary, model


def score(seqs: DataFrame, vocabulary: Vocabulary, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text)."""
    n = vocabulary.n

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                classes, sizes = _unzip(r["classes"], "<u2"), np.array(r["size"], dtype=np.int64)
                s = np.concatenate([forward(model, own, z) for _, _, own, z in _batches(classes, sizes)])
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "doc_id": pd.array(r["doc_id"], dtype="Int64"), "held_out": r["held"], "n_tokens": sizes,
                    "n_known": np.array(r["known"], dtype=np.int64), "train_tokens": np.full(len(sizes), n),
                    "base_score": r["base"], "score": s + np.array(r["inner"])}), preserve_index=False)

    return seqs.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")


def hmm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    return score(*train(docs, rounds))
