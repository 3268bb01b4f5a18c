"""Corpus pipeline over ``documents``: drop toxic texts, keep one text of each near-duplicate
group, remove repeated passages, mix sources to their target weights, encode.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept.  All but
the last return the columns of ``documents``; the mix returns one row per draw, so a document that
is drawn twice occurs twice.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterkit.llm import bpe, jaccard, mixing, suffixes, toxicity
from rosterkit.llm.common import cut, scratch, table, whole_text
from rosterkit.session import scratch_scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# The pipeline removes passages of over 50 words that also start elsewhere, whatever their length in bytes.
PASSAGE_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: learn from the labels of the documents, drop those predicted toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 (five-word shingles, 0.8): of each group one row stays, the one with the least id.

    Rows with an id come before rows with none, and equal ids are ordered by a hash of their text: the verdict
    is on rows, not on ids.  Documents without a word are linked with nothing and stay.  Of rows with the same
    id and the same text, the one with the least (lang, source, n_chars) stays.
    """
    path = scratch(spark, "survivors")
    with scratch_scope(spark):   # only the survivors are read once they are known
        stay = cut(jaccard.survivors(docs, words=5, percent=80).select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey")), "survivors", path)
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["_id"]) & (F.xxhash64(whole_text()) == stay["_tkey"]), "left_semi")
    kept = kept.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("row"))
    return kept.select("doc_id", "text", "row.lang", "row.source", "row.n_chars").select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 over words: cut every passage of PASSAGE_WORDS words that also starts elsewhere."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", F.col("text").isNull().alias("no_text"))
    # one row out for each row in, with its own columns: nothing is joined back on the id
    kept = suffixes.dedup(rows, PASSAGE_WORDS, with_text=True, unit="words", others=["lang", "source", "n_chars", "no_text"])
    text = F.when(~F.col("no_text"), F.col("kept").cast("string"))  # passages are whole words, so no character is cut in two
    n_chars = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one row per draw, shard by shard and shuffled inside; a document that a draw takes in part stays whole."""
    return mixing.in_shards(mixing.mix(docs)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the ids of every text, and a proof of the round trip."""
    done = bpe.encode_decode(docs.select(*COLUMNS), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return done.select("doc_id", "lang", "source", "n_tokens", "ids",
                       (F.col("decoded") == whole_text().cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("suffix_dedup", remove_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# SQL cannot express the classifier, the suffix tables, the splitting tree or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
