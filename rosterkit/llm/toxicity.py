"""Operator 4: toxicity by a counterfactually regularised classifier.

A logistic model over the presence of words.  Its words are those whose
document frequency differs between the classes by at least MIN_Z standard
deviations, and all identity terms.  Sentences of training texts that name an
identity group are copied with the terms swapped for others of their category,
and the squared change of the score between a sentence and its copies is added
to the loss with weight FAIRNESS: a neutral mention of a group must not move
the score.

The fit uses a bounded sample: at most MAX_ROWS labelled training texts of each
class, in order of a hash of doc_id, and at most MAX_WORDS words.  Scoring is
narrow and covers whole texts.

Defined cases: null and empty texts get the score of the constant alone; rows
with a null id or no label do not train; a label counts as toxic if any of its
rows does; repeated documents train once; without training rows of both
classes every word weighs 0; clashing input columns come back as ``<name>_in``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, id_crc, keep_clear, tidy, whole_text

MAX_ROWS = 10_000     # sampled training texts of each class
MAX_WORDS = 20_000
MIN_Z = 4.0
MIN_TEXTS = 4         # texts that hold a word
L2 = 2e-4
FAIRNESS = 1.0
STEPS = 400
SWAPS = 2             # copies of a sentence

# Identity terms by category; a swap replaces a term by a later one of its row.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "asian", "latino", "african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("deaf", "blind", "disabled", "autistic"), ("immigrants", "refugees", "foreigners", "citizens"), ("old", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_NEXT = {t: row[(i + 1) % len(row)] for row in IDENTITY for i, t in enumerate(row)}
# ASCII letters are lower-cased, other ASCII characters but letters part words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_SENTENCE = re.compile(r"[.!?\n]+")
OUT = ["score", "predicted"]


def text_words(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def swaps(text: str) -> list[tuple[frozenset[bytes], frozenset[bytes]]]:
    """For each sentence that names a group: the terms taken out and put in by each of its copies."""
    out = []
    for sentence in _SENTENCE.split(text):
        terms = {w.decode("utf-8", "replace") for w in text_words(sentence)} & _NEXT.keys()
        to = {t: t for t in terms}
        for _ in range(SWAPS if terms else 0):
            to = {t: _NEXT[x] for t, x in to.items()}
            new = set(to.values())
            if new != terms:
                out.append((frozenset(t.encode() for t in terms - new), frozenset(t.encode() for t in new - terms)))
    return out


@dataclass
class Model:
    words: dict[bytes, float]
    constant: float

    def score(self, texts: list[str]) -> np.ndarray:
        w = self.words
        known = w.keys()
        z = np.array([self.constant + sum(sorted(w[x] for x in text_words(t) & known)) for t in texts])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Training texts (doc_id, text, toxic): at most ``max_rows`` of each class, by a hash of the id."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (id_crc() % 5 != 0))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    own = own.withColumn("h", F.xxhash64(F.lit(4), "doc_id"))
    both = [own.where(F.col("toxic") == k).orderBy("h", "doc_id").limit(max_rows).select("doc_id", "toxic") for k in (0, 1)]
    ids = F.broadcast(both[0].unionByName(both[1]))  # at most 2 * max_rows rows
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(ids, "doc_id")
    return d.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _word_counts(sample: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            counts = (Counter(), Counter())
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                counts[y].update(text_words(t))
            words = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([counts[0][w] for w in words], pa.int64()),
                                              pa.array([counts[1][w] for w in words], pa.int64())], names=["word", "n0", "n1"])

    d = sample.select("text", "toxic").mapInArrow(tidy(run), "word binary, n0 long, n1 long")
    return d.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _features(sample: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """Per sampled text: its label, its words' places, and the places taken out and put in by each swap."""
    def run(batches):
        known = index.keys()
        for b in batches:
            texts = b.column("text").to_pylist()
            at = lambda ws: sorted(index[w] for w in ws if w in index)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("toxic"), pa.array([at(text_words(t) & known) for t in texts], pa.list_(pa.int32())),
                 pa.array([[x for o, i in swaps(t) for x in [*[-1 - k for k in at(o)], *at(i), 1 << 30]] for t in texts], pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "places", "swaps"])

    return sample.select("doc_id", "text", "toxic").mapInArrow(tidy(run), "doc_id long, toxic int, places array<int>, swaps array<int>")


def _optimise(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, pair: np.ndarray, place: np.ndarray, sign: np.ndarray,
              n_words: int, class_weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the weighted log loss, the ridge and the counterfactual penalty."""
    n, n_pairs = len(y), int(pair.max()) + 1 if len(pair) else 0
    weight = class_weight[y] / class_weight[y].sum()
    per_text = np.bincount(rows, minlength=n) + 1
    bound = 0.25 * float(np.sum(weight * per_text)) + L2
    if n_pairs:
        bound += 2 * FAIRNESS * float(np.bincount(pair, weights=np.abs(sign), minlength=n_pairs).max())
    w, c = np.zeros(n_words), 0.0
    v, d, t = w.copy(), c, 1.0
    for _ in range(STEPS):
        z = d + np.bincount(rows, weights=v[cols], minlength=n)
        r = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = np.bincount(cols, weights=r[rows], minlength=n_words) + L2 * v
        if n_pairs:  # change of the score between a sentence and its copy
            change = np.bincount(pair, weights=sign * v[place], minlength=n_pairs)
            g += 2 * FAIRNESS / n_pairs * np.bincount(place, weights=sign * change[pair], minlength=n_words)
        nw, nc = v - g / bound, d - r.sum() / bound
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, d = nw + (t - 1) / nt * (nw - w), nc + (t - 1) / nt * (nc - c)
        w, c, t = nw, nc, nt
    return w, float(c)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model:
    sample = cut(_sample(docs, labels, max_rows), "toxicity_sample")
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        p = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1)
        return Model({}, float(np.log(p / (1 - p))))
    n, p = sum(total.values()), total[1] / sum(total.values())
    df = F.col("n0") + F.col("n1")
    z = (F.col("n1") - df * p) / F.sqrt(df * (p * (1 - p)) * (1 - df / F.lit(n + 1.0)))
    counts = _word_counts(sample).where(df >= MIN_TEXTS).where(F.abs(z) >= MIN_Z)
    best = counts.orderBy(F.abs(z).desc(), "word").limit(max_words).select("word").collect()
    words = sorted({bytes(r["word"]) for r in best} | {t.encode() for t in _NEXT})
    index = {w: i for i, w in enumerate(words)}
    x = _features(sample, index).toArrow().sort_by("doc_id")   # at most 2 * max_rows texts, places among max_words words
    y = np.array(x.column("toxic").to_pylist(), dtype=np.int64)
    places = x.column("places").to_pylist()
    rows = np.repeat(np.arange(len(places)), [len(q) for q in places])
    cols = np.array([k for q in places for k in q], dtype=np.int64)
    pair, place, sign, k = [], [], [], 0
    for q in x.column("swaps").to_pylist():
        for s in q:
            if s == 1 << 30:
                k += 1
                continue
            pair.append(k)
            place.append(s if s >= 0 else -1 - s)
            sign.append(1.0 if s >= 0 else -1.0)
    w, c = _optimise(rows, cols, y, np.array(pair, dtype=np.int64), np.array(place, dtype=np.int64), np.array(sign),
                     len(words), np.array([n / (2 * total[0]), n / (2 * total[1])]))
    return Model({x: float(v) for x, v in zip(words, w) if v}, c)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5)."""
    docs = keep_clear(docs, OUT).withColumn("text", whole_text())
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for b in batches:
            s = model.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                             names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(tidy(run), schema)
