"""Hashed text features as Arrow batches: counts for the bounded training sample, and one summed weight a text for scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlore.llm import texts as T


PAIR_HASHES = 4


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text falls into `part` of `parts`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


def first_by_hash(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """A bounded sample that depends on the keys alone: the `limit` rows whose keys hash lowest."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit("sample")), key).limit(limit)


def features(data: np.ndarray, at: np.ndarray, buckets: int, sizes: tuple[int, ...], with_words: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of every byte n-gram of the sizes, of every word, and of every pair of words written with a back reference.

    A pair's second word is written as "same" or "other" beside the first, which is left open: two patterns, each hashed `PAIR_HASHES` times,
    so that texts that say each word again and again share features whatever their words are.
    """
    for n in sizes:
        h, doc = T.grams(data, at, n)
        yield (T.mix(h + np.uint64(n)) % np.uint64(buckets)).astype(np.int64), doc
    if with_words:
        h, doc, _, _ = T.words(data, at)
        yield (h % np.uint64(buckets)).astype(np.int64), doc
        near = doc[1:] == doc[:-1]
        same = (h[1:] == h[:-1])[near].astype(np.uint64)
        for i in range(PAIR_HASHES):
            yield (T.mix(same * np.uint64(PAIR_HASHES) + np.uint64(i + 1)) % np.uint64(buckets)).astype(np.int64), doc[1:][near]


def counts(texts: pa.Array, buckets: int, sizes: tuple[int, ...], with_words: bool, lower: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its sorted feature buckets and how often each occurs."""
    out = []
    for a, b in T.slices(texts):
        own = texts[a:b]
        data, at = T.utf8(pc.utf8_lower(own) if lower else own)
        found = list(features(data, at, buckets, sizes, with_words))
        key = np.concatenate([doc * buckets + f for f, doc in found])
        key, n = np.unique(key, return_counts=True)
        cut = np.searchsorted(key, np.arange(b - a + 1) * buckets)
        out += [(key[i:j] % buckets, n[i:j]) for i, j in zip(cut[:-1], cut[1:])]
    return out


def sparse_rows(rows: DataFrame, buckets: int, sizes: tuple[int, ...], with_words: bool, lower: bool) -> DataFrame:
    """(label, at, n): the feature counts of `rows` (label, text), no more than `buckets` numbers a row however long its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, text = T.columns_of(batch, "label", "text")
            found = counts(text, buckets, sizes, with_words, lower)
            yield pa.RecordBatch.from_arrays([label, pa.array([f.astype(np.int32) for f, _ in found], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))], ["label", "at", "n"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("label", "text").mapInArrow(run, f"label {kind}, at array<int>, n array<int>")
