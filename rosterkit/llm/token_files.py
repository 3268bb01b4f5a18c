"""Operator 5: token ids in ORC files.

Documents are ranged by doc_id, encoded, and written as ORC: integers are
run-length encoded, stripes carry row indexes (minimum and maximum of doc_id
for each ``row.index.stride`` rows) and Bloom filters on doc_id.  Files are in
doc_id order, and rows in a file too, so a reader prunes files, stripes and row
groups by id, and stripes are read in parallel.

Scale: one range shuffle of (doc_id, text); ids are made after it, streamed
through Arrow in slices of about 1 MB of text.  A document's place in the whole
id sequence is a running sum inside its file plus the file's base; the base
comes from a table with one row per file.

Defined cases: null text is empty (its row holds the end id alone); null ids
come first; repeated ids are ordered by a hash of their text; extra columns are
left out; an empty table gives files without rows.  The string of a token added to
the vocabulary (``<|endoftext|>``) becomes that token's id, as the library has it by
default: a text that holds one goes to the library whole, without the memo.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import chunks
from .bpe import byte_characters
from .common import scratch, tidy, whole_text

END_ID = 2
ORC = {
    "orc.compress": "ZSTD",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "doc_id long, row long, n_tokens long, ids array<int>"


def library(path: str):
    """Encode matches of the split pattern with the tokenizers library's merge model: list of strings -> ids as bytes.

    Matches could cut the string of an added token, so texts that hold one are for ``whole_library``.
    """
    from tokenizers import Tokenizer
    merge = Tokenizer.from_file(path).model.tokenize
    to_chars = {**dict(enumerate(byte_characters())), 0xFF: "\n"}  # 0xFF never occurs in UTF-8: it parts the strings

    def many(items: list[str]) -> list[bytes]:
        mapped = b"\xff".join([x.encode() for x in items]).decode("latin-1").translate(to_chars).split("\n")
        return [array("I", [m.id for m in merge(x)]).tobytes() for x in mapped]

    return many


@lru_cache(maxsize=8)
def whole_library(path: str):
    """The strings of the vocabulary's added tokens, and the unmodified library for whole texts (ids as bytes)."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    return added, lambda x: array("I", t.encode(x, add_special_tokens=False).ids).tobytes()


def encode(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, n_tokens, ids) in ascending doc_id order; ``row`` counts from 0 in every partition."""

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = chunks.encoder(library, tokenizer, pattern)
        added, whole = whole_library(tokenizer)
        end, row = np.array([end_id], dtype="<u4").tobytes(), 0
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in chunks.slices(texts):
                own = texts[i:j]
                special = [any(a in t for a in added) for t in own]
                plain = iter(enc.batch([t for t, s in zip(own, special) if not s]))
                ids = [(whole(t) if s else next(plain)) + end for t, s in zip(own, special)]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                values = np.frombuffer(b"".join(ids), dtype="<i4")
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(np.arange(row, row + j - i)), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=["doc_id", "row", "n_tokens", "ids"])
                row += j - i

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("_t", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_t").asc()]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    return d.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def write(encoded: DataFrame, path: str) -> str:
    encoded.write.mode("overwrite").options(**ORC).orc(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows with their file's name; filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_name"))


def digests(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            off, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            view = memoryview(values).cast("B")
            crc = [zlib.crc32(view[4 * x:4 * y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("file"), b.column("row"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    # part files are numbered with at least five digits: the number orders them, not the name
    files = files.withColumn("file", F.struct(F.regexp_extract("file", r"part-(\d+)", 1).cast("long").alias("number"), F.col("file").alias("name")))
    d = files.select("doc_id", "file", "row", "ids").mapInArrow(
        tidy(run), "doc_id long, file struct<number: long, name: string>, row long, n_tokens long, ids_crc32 long")
    d = d.withColumn("_in", F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row")) - F.col("n_tokens"))
    per = files.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    per = per.select(F.col("file").alias("_file"), (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_base"))
    d = d.join(per, d["file"] == per["_file"])
    return d.select("doc_id", (F.col("_base") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32", F.col("file.name").alias("file"), "row")


def write_and_read(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Encode, write to ``path`` (default: the shared checkpoint folder) and read the files back."""
    spark = docs.sparkSession
    return read(spark, write(encode(docs, tokenizer, pattern, end_id), path or scratch(spark, "tokens")))
