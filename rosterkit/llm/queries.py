"""Registered queries of the operators: each applies its operator to its whole table.

A query derives its digest columns from the operator's own output.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, hmm, jaccard, lines, mixing, quality, roles, structure, suffixes, token_files, toxicity, trie
from .common import id_crc, table
from .oracle import ORACLE  # noqa: F401


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda x: x["shard"]).alias("shards"))


def op2_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.repair(table(spark, sf_dir, "conversations"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.repeats(docs, n_bytes=400, n_words=51)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs, words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    q = quality.quality(docs, with_text=False)
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "distance", "kept")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fingerprints.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    like = fingerprints.likeness
    return e.select("doc_id", F.length("text").cast("long").alias("n_chars"),
                    F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                    "fingerprint", "edited_fingerprint",
                    like(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    like(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", "predicted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_files.write_and_read(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN)
    return token_files.digests(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs, min_chars=40, min_docs=5, with_text=False).drop("kept")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repair(table(spark, sf_dir, "conversations"))


REGISTRY = {f.__name__: f for f in (op1_mix, op2_role_repair, op3_suffix_dedup, op4_toxicity, op5_token_files, op6_bpe, op7_jaccard, op8_hmm,
                                    op9_quality, op10_fingerprint, op11_lines, op12_trie, op13_repair)}
