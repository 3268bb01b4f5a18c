"""Operator 6: byte-level BPE encoding and decoding with a sentencepiece model built from the vocabulary.

The model is serialised here, piece by piece: every vocabulary entry's bytes
are mapped to one character each, its score is its negative rank, and the
normaliser is the identity; so the best merge is always the pair of least rank,
leftmost first, and a piece's id is its rank.  Texts are split by the
vocabulary's pattern and each match is encoded by itself; decoding looks every
id's bytes up.

Scale: narrow, no shuffle; texts stream through Arrow in slices, the memo of
encoded matches is bounded in bytes.

Defined cases: null text is empty (no ids); ids are little-endian unsigned 32
bit; repeated rows are encoded alike; clashing input columns come back as
``<name>_in``.
"""

from __future__ import annotations

import base64
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks
from .common import keep_clear, tidy, whole_text

OUT = ["n_tokens", "ids", "decoded"]


def byte_characters() -> list[str]:
    """One printable character for every byte: itself where that is printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's entries by rank."""
    with open(path, "rb") as f:
        pairs = [(int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip())]
    out = [b""] * len(pairs)
    for r, t in pairs:
        out[r] = t
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: bytes (type 2), float (type 5) or integer (type 0)."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(entries: list[bytes]) -> bytes:
    """A serialised BPE model: pieces in rank order, then the unknown piece."""
    chars = byte_characters()
    pieces = [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(r)) for r, t in enumerate(entries)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # trainer: model type BPE (2), size, id of the unknown piece; no begin, end or padding piece (-1)
    absent = (1 << 64) - 1
    trainer = (_field(3, 2) + _field(4, len(pieces)) + _field(40, len(entries)) + _field(41, absent) + _field(42, absent)
               + _field(43, absent))
    # normaliser: identity, no added or removed or escaped spaces
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def library(path: str):
    """Encode strings that are matches of a pattern, with the sentencepiece model of a rank file: ids as bytes.

    All strings of a call go to the library at once, their bytes mapped to characters in one pass.
    """
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(read_ranks(path)))
    to_chars = {**dict(enumerate(byte_characters())), 0xFF: "\n"}  # 0xFF never occurs in UTF-8: it parts the strings

    def many(items: list[str]) -> list[bytes]:
        mapped = b"\xff".join([x.encode() for x in items]).decode("latin-1").translate(to_chars).split("\n")
        return [array("I", x).tobytes() for x in sp.encode(mapped, out_type=int, num_threads=1)]

    return many


_ENTRIES: dict[str, list[bytes]] = {}


def decode(path: str, ids: bytes) -> bytes:
    """The bytes of packed ids."""
    if path not in _ENTRIES:
        _ENTRIES[path] = read_ranks(path)
    return b"".join(map(_ENTRIES[path].__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The documents with ``n_tokens``, ``ids`` (binary) and ``decoded`` (binary: the bytes of the ids)."""
    docs = keep_clear(docs, OUT).withColumn("text", whole_text())
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        enc = chunks.encoder(library, ranks, pattern)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in chunks.slices(texts):
                ids = enc.batch(texts[i:j])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([decode(ranks, x) for x in ids], pa.binary())],
                    names=[*part.schema.names, "n_tokens", "ids", "decoded"])

    return docs.mapInArrow(tidy(run), schema)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
