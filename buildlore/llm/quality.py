"""Quality classifier by supervised subword embeddings.

Every word and every byte 3- and 4-gram of a text is hashed to a learned vector; a document is the average of its vectors, and a softmax over
two classes follows. Vectors and softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. Since the
output is linear in the average, scoring needs one learned number a bucket, so the whole corpus is scored where it is read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from buildlore.llm import linear
from buildlore.llm import texts as T
from buildlore.llm.base import query, table

SAMPLE_ROWS = 3000  # the bound of the training sample
BUCKETS = 1 << 15
DIMENSION = 8
SIZES = (3, 4)
EPOCHS = 4  # or more, until a small sample has given as many steps as `LEAST_STEPS`
LEAST_STEPS = 12_000
RATE = 0.3
ACCEPT = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # what one occurrence of a bucket adds to the log odds, before averaging
    bias: float


def train(at: list[np.ndarray], n: list[np.ndarray], labels: np.ndarray) -> Model:
    """Stochastic gradient descent over embeddings and softmax; the order and the start are fixed, so equal samples give equal models."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    out = rng.normal(0, 0.1, (DIMENSION, 2))
    bias = np.zeros(2)
    share = [c / max(1, c.sum()) for c in n]
    epochs = max(EPOCHS, LEAST_STEPS // max(1, len(labels)))
    steps, step = epochs * max(1, len(labels)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share[i] @ vectors[at[i]]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            # the average spreads one step over all of a text's features; scaling it back lets rare features learn as fast
            vectors[at[i]] -= (rate * 20) * share[i][:, None] * back
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows outside the held-out fifth.

    Labels other than 0 and 1 and null keys are left out; of several labels of one document the smallest counts. `sample_rows` bounds the
    sample, which is chosen by a hash of the key; without labelled rows every text scores one half.
    """
    usable = labels.filter("quality in (0, 1) and doc_id is not null").filter(~linear.held_out("doc_id", 5, 0))
    chosen = linear.first_by_hash(usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")), "doc_id", sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = linear.sparse_rows(rows.select("label", "text"), BUCKETS, SIZES, True, False).toArrow()
    at = [np.asarray(got["at"][i].values) for i in range(got.num_rows)]
    n = [np.asarray(got["n"][i].values) for i in range(got.num_rows)]
    y = np.array(got["label"].to_pylist(), np.int64)
    if not len(y):
        return Model(np.zeros(BUCKETS), 0.0)
    # the sample arrives in the order of its tasks; sort it, so that the model depends on the rows alone
    rank = sorted(range(len(y)), key=lambda i: (len(at[i]), int(n[i].sum()), at[i].tobytes(), int(y[i])))
    return train([at[i] for i in rank], [n[i] for i in rank], y[rank])


def with_score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """`docs` (with a column `text`) and the likelihood of label 1 from the whole text alone.

    An empty or null text has no features and scores by the bias. Rows keep all their columns and repeat as they come, null keys too; an
    empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            (texts,) = T.columns_of(batch, "text")
            for a, b in T.slices(texts):
                data, at = T.utf8(texts[a:b])
                total, count = np.zeros(b - a), np.zeros(b - a)
                for bucket, doc in linear.features(data, at, BUCKETS, SIZES, True):
                    total += np.bincount(doc, weights[bucket], b - a)
                    count += np.bincount(doc, None, b - a)
                odds = total / np.maximum(count, 1) + bias
                yield batch.slice(a, b - a).append_column(out, pa.array(1 / (1 + np.exp(-np.clip(odds, -40, 40)))))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", linear.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
