"""Writers: append-only event logs and one-result-per-snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_events(df: DataFrame, path: str, *partition_by: str) -> None:
    """Add rows to an append-only log; existing files are never rewritten."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def stream_events(df: DataFrame, path: str, checkpoint: str):
    """The same sink for a stream; the file sink's own log makes each batch land once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def upsert_snapshots(df: DataFrame, path: str, keys: list[str], version: str, buckets: int = 64) -> None:
    """Keep the newest record of every snapshot. Only the buckets that receive new records are read and rewritten."""
    spark: SparkSession = df.sparkSession
    bucket: Column = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    fresh = df.withColumn("bucket", bucket)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        touched = fresh.select("bucket").distinct()
        old = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi")
        fresh = old.unionByName(fresh)
    from buildlore.session import materialize

    merged = materialize(newest(fresh, [*keys, "bucket"], version))
    (
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket").parquet(path)
    )


def newest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one with the highest version: a partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.col(version)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*")
