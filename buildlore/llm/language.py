"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector over hashed byte n-grams of its lower-cased form. Document frequencies cover every training document;
a bounded sample of each language is clustered into several centroids by spherical k-means; a text gets the language of the centroid of
highest cosine and is marked as rejected where even that one is farther than almost all of the language's own sample. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlore.llm import linear
from buildlore.llm import texts as T
from buildlore.llm.base import query, table

SAMPLE_ROWS = 2400  # the bound of the sample that is clustered, all languages together; 20 a language at least
LANGUAGES = 1000  # more labels than that are taken for an error
BUCKETS = 1 << 12
SIZES = (1, 2, 3)
CENTROIDS = 4
ROUNDS = 8
REJECT_QUANTILE = 0.001
DENSE_ROWS = 256


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # unit vectors, one a row
    labels: list[str]  # of each centroid
    limits: np.ndarray  # cosine below which a text is rejected, by centroid


def _letters(text: pa.Array) -> pa.Array:
    """Lower-cased words with one space around each; whatever is no letter tells nothing about the language."""
    return pc.replace_substring_regex(pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(text, "")), "", " "), r"[^\pL]+", " ")


def _dense(text: pa.Array) -> np.ndarray:
    """How often each bucket occurs in each of a few texts."""
    data, at = T.utf8(_letters(text))
    rows = len(text)
    out = np.zeros(rows * BUCKETS)
    for bucket, doc in linear.features(data, at, BUCKETS, SIZES, False):
        out += np.bincount(doc * BUCKETS + bucket, None, rows * BUCKETS)
    return out.reshape(rows, BUCKETS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def _parts(text: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b in T.slices(text):
        for i in range(a, b, DENSE_ROWS):
            yield i, min(b, i + DENSE_ROWS)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all rows (column text) each bucket occurs, and the number of rows; each task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            (text,) = T.columns_of(batch, "text")
            n += len(text)
            for a, b in _parts(text):
                total += (_dense(text[a:b]) > 0).sum(axis=0)
        at = np.r_[np.flatnonzero(total), BUCKETS]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.r_[total, n][at])], ["at", "n"])

    found = rows.select("text").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n")).collect()  # a row a bucket
    out = np.zeros(BUCKETS + 1, np.int64)
    for at, n in found:
        out[at] = n
    return out[:BUCKETS], int(out[BUCKETS])


def _cluster(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with fixed starts: the mean's nearest text, then each time the text least like the starts so far."""
    start = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(start) < min(k, len(v)):
        start.append(int(np.argmin((v @ v[start].T).max(axis=1))))
    c = v[start]
    for _ in range(ROUNDS):
        near = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (v @ c.T).max(axis=1)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows (doc_id, text, lang) outside the held-out third; rows with a null text or language are left out."""
    usable = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").filter(~linear.held_out("doc_id", 3, 1))
    df, n = document_frequencies(usable)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_size"))
    languages = sizes.limit(LANGUAGES + 1).count()
    if languages > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    each = max(20, sample_rows // max(1, languages))
    # keys whose hash is low enough for about twice `each` a language; only those are ranked
    hashed = F.xxhash64("doc_id", F.lit("sample"))
    low = F.pmod(hashed, F.lit(1 << 30)) <= F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(2.0 * each + 40) / F.col("_size"))
    near = usable.select("doc_id", "lang").filter("doc_id is not null").join(F.broadcast(sizes), "lang").filter(low)
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    chosen = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= each).select("doc_id", F.col("lang").alias("label")).distinct()
    rows = usable.filter("doc_id is not null").select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").filter("lang = label")
    rows = rows.select("label", F.regexp_replace(F.concat(F.lit(" "), F.lower("text"), F.lit(" ")), r"[^\p{L}]+", " ").alias("text"))
    got = linear.sparse_rows(rows, BUCKETS, SIZES, False, False).toArrow()
    if not got.num_rows:
        return Model(idf, np.zeros((0, BUCKETS)), [], np.zeros(0))
    counts = np.zeros((got.num_rows, BUCKETS))
    for i in range(got.num_rows):
        counts[i, np.asarray(got["at"][i].values)] = np.asarray(got["n"][i].values)
    label = np.array(got["label"].to_pylist(), object)
    v = _vectors(counts, idf)
    found, names, limits = [], [], []
    for name in sorted(set(label)):
        own = v[label == name]
        own = own[np.lexsort(own[:, : min(8, BUCKETS)].T)]
        c, near = _cluster(own, CENTROIDS)
        found.append(c)
        names += [name] * len(c)
        limits += [float(np.quantile(near, REJECT_QUANTILE)) * 0.9] * len(c)
    return Model(idf, np.concatenate(found), names, np.array(limits))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) of every row, from its whole text alone.

    The score is the cosine with the nearest centroid. A text that is null or has no letter is `und` with score 0. Equal cosines go to the
    language first in the alphabet. `rejected` tells that the text lies farther from its nearest centroid than the language's sample does,
    so a caller can treat the language as unknown. Rows repeat as they come; a model without languages says `und` everywhere.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, texts, letters = T.columns_of(batch, "_key", "_text", "_letters")
            for a, b in _parts(texts):
                if m.labels:
                    cosine = np.clip(_vectors(_dense(texts[a:b]), m.idf) @ m.centroids.T, 0, 1)
                    best = cosine.argmax(axis=1)
                    said, score = np.array(m.labels, object)[best], cosine[np.arange(b - a), best]
                    far = score < m.limits[best]
                else:
                    said, score, far = np.full(b - a, "und", object), np.zeros(b - a), np.ones(b - a, bool)
                known = np.asarray(letters[a:b].to_numpy(zero_copy_only=False), bool)
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array(np.where(known, said, "und"), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(far | ~known)],
                    ["_key", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    return slim.mapInArrow(run, f"_key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("_key", key)


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = predict(docs.select("doc_id", "text"), fit(docs))
    return said.select("doc_id", linear.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
