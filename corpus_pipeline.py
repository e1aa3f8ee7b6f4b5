"""A training-data pipeline over `documents`: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.llm import byte_bpe, decontamination, ngram_join, paragraph_dedup, quality
from buildlore.llm.base import fresh, table
from buildlore.session import drop_table, materialize, write_table

__all__ = ["ORACLE_SQL", "STAGES", "materialize", "run"]

BATCH_ROWS = 1000  # rows that go to a Python worker at a time; whole documents are long, and workers of earlier stages still hold their last batch
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage):
    """`stage` with batches of at most `BATCH_ROWS` rows in the session; results do not depend on it. `run` puts the setting back."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = int(spark.conf.get(BATCH_SETTING))
        spark.conf.set(BATCH_SETTING, str(min(BATCH_ROWS, before) if before > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return call


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled ones among them."""
    score = fresh(docs, "_score")
    scored = quality.with_score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), score)
    return scored.filter(F.col(score) >= quality.ACCEPT).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the paragraphs that another document, or an earlier place, has already."""
    return paragraph_dedup.without(docs, paragraph_dedup.repeats(docs, marks=True))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no piece of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids as little-endian unsigned 32-bit integers, and a digest of what they decode to."""
    out = byte_bpe.encode(docs, public_tokenizers.path(byte_bpe.VOCABULARY))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", small_batches(keep_good)),
    ("n-gram Jaccard join", small_batches(drop_near_copies)),
    ("substring dedup", small_batches(cut_repeats)),
    ("benchmark decontamination", small_batches(drop_benchmark)),
    ("byte-level BPE", small_batches(to_tokens)),
]

#: Training a classifier is no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. The tables of the stages before are dropped as soon as the next one is written, and the session's setting is as before."""
    docs, place, before = table(spark, sf_dir, "documents"), None, spark.conf.get(BATCH_SETTING)
    try:
        for _, stage in STAGES:
            docs, now = write_table(stage(spark, docs, sf_dir))
            if place:
                drop_table(spark, place)
            place = now
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
