"""Byte-level BPE encoding and decoding through a sentencepiece model made straight from a rank file.

The model's pieces are the vocabulary's byte strings written with one printable character a byte, scored by negative rank, so that
sentencepiece merges in rank order; its normaliser is the identity. Texts are cut into pre-tokens, every pre-token is encoded by itself, and
decoding maps ids back to their bytes. Nothing is shuffled: each task encodes the texts it reads.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.llm.base import query, table
from buildlore.llm.texts import columns_of, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MODEL_BYTES = 64 << 20
REMEMBERED = 100_000
LONGEST_REMEMBERED = 40


def read_ranks(path: str) -> list[bytes]:
    """The byte string of every rank; ranks are 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(piece) for piece, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks in {path} have gaps")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> list[str]:
    """One printable character for each byte: visible Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialised_model(ranks: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the pieces in rank order, so an id is its rank, and after them the unknown piece the format asks for."""
    chars = byte_characters()
    pieces = [
        _block(1, _block(1, "".join(chars[b] for b in piece).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, 1))
        for rank, piece in enumerate(ranks)
    ]
    pieces.append(_block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    none = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(ranks)) + _number(41, none) + _number(42, none) + _number(43, none)
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class Encoder:
    """Encodes and decodes texts in one Python process; pre-tokens met before are remembered, up to a bound."""

    def __init__(self, model: bytes, ranks: list[bytes], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces, self.find = ranks, regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> dict[str, bytes]:
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for t in tokens]
        return {t: np.array(ids, "<u4").tobytes() for t, ids in zip(tokens, self.model.encode(mapped, out_type=int, num_threads=1))}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        tokens = [self.find(t) for t in texts]
        met = set().union(*tokens)
        new = [t for t in met if t not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(met)
        fresh = self._learn(new) if new else {}
        self.known.update(fresh)
        out = [b"".join(map(self.known.__getitem__, t)) for t in tokens]
        for t in fresh:
            if len(t) > LONGEST_REMEMBERED:
                del self.known[t]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _encoder(model: bytes, pattern: str) -> Encoder:
    """Built once in each Python worker; the pieces' bytes are read back from the model itself."""
    code = {c: b for b, c in enumerate(byte_characters())}
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    return Encoder(model, [bytes(code[c] for c in own.id_to_piece(i)) for i in range(own.get_piece_size() - 1)], pattern)


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): each text's ids, packed as little-endian unsigned 32-bit integers, and the bytes they decode to.

    A null text counts as empty and has no ids. Rows are kept as they are, repeated ones and those with a null key too; other columns of
    `docs` are not looked at. An empty table gives an empty table. `ids_array` unpacks the ids.
    """
    model = serialised_model(read_ranks(path))
    if len(model) > MODEL_BYTES:
        raise ValueError(f"the model takes {len(model)} bytes, more than the {MODEL_BYTES} it may")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            ids_of, texts = columns_of(batch, "_key", "_text")
            for a, b in slices(texts):
                packed = encoder.encode([t or "" for t in texts[a:b].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [ids_of[a:b], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array([encoder.decode(p) for p in packed], pa.binary())],
                    ["_key", "n_tokens", "ids", "decoded"],
                )

    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return slim.mapInArrow(run, f"_key {kind}, n_tokens bigint, ids binary, decoded binary").withColumnRenamed("_key", key)


def ids_array(packed):
    """Packed ids as an array of integers, for readers that want one."""
    width = F.lit(8)
    digits = F.hex(packed)
    word = lambda i: F.conv(F.concat(*[F.substring(digits, i * width + 7 - 2 * j, F.lit(2)) for j in range(4)]), 16, 10).cast("bigint")
    n = (F.octet_length(packed) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
