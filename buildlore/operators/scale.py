"""Helpers that keep one hot key from landing in one task: ranks, counts and cut points without whole-key windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlore.session import materialize

ID_BUCKET = 65536


def running_index(df: DataFrame, keys: Sequence[str], order_id: str, out: str, width: int = ID_BUCKET) -> DataFrame:
    """1-based row number per key in the order of a unique integer id.

    Rows are ranked inside id ranges of `width`, so no window ever sees more than `width` rows; the running total that
    lifts a range's ranks runs over one row per range.
    """
    bucket = F.floor(F.col(order_id) / F.lit(width)).alias("_bucket")
    df = df.select("*", bucket)
    base = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order_id))
    return (
        df.withColumn("_rn", inside)
        .join(base, [*keys, "_bucket"])
        .withColumn(out, F.col("_rn") + F.col("_base"))
        .drop("_bucket", "_rn", "_base")
    )


def ordered_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position per key for any unique sort order (strings included).

    The rows are range-partitioned by key and order, which spreads one large key over many ranges, and written once so
    the ranges cannot move between the two reads. Offsets then need one row per (key, range).
    """
    ranged = materialize(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return (
        ranged.withColumn("_rn", inside)
        .join(base, [*keys, "_range"])
        .withColumn(out, F.col("_rn") + F.col("_base"))
        .drop("_range", "_rn", "_base")
    )


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores, if what it reads is too small to give each of them a full task: one row group cannot be read by several.

    For work that costs much a row. Large inputs are left as they are read, so their rows do not move; results do not depend on it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    read = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    full = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if read < cores * full else df


def dealt(df: DataFrame) -> DataFrame:
    """`df` in four parts a core, dealt row by row: for few rows that cost very unequal work, which sizes in bytes do not tell."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def dealt_by(df: DataFrame, key: str, source: DataFrame, size: int = 4 << 20) -> DataFrame:
    """`df` by `key`, in a partition for every `size` bytes of the files of `source`, which it is made from: for rows that grow in the task they are dealt to."""
    read = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-read // size)
    # fewer than usual are left to Spark, which may join small ones
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int, out: str) -> DataFrame:
    """Top rows per key. Spark cuts each map task's rows to `limit` per key before the shuffle (window group limit)."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= limit)


def attach_counts(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Per-key aggregates joined back to every row: partial aggregation first, then a join AQE can split or broadcast."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), list(keys))


def gap_sessions(df: DataFrame, keys: Sequence[str], t: str, tie: str, gap: float, out: str) -> DataFrame:
    """Number the runs of rows that no pause of `gap` or more interrupts, per key; numbers only have to be distinct.

    Whether a row starts a run depends on the row before it. That row is in the same slice of `gap` length, or in the
    slice before (an equi-join on one aggregated row per slice), or too far back to matter.
    """
    keys = list(keys)
    df = df.withColumn("_slice", F.floor(F.col(t) / F.lit(gap)))
    last = df.groupBy(*keys, "_slice").agg(F.max(t).alias("_last"))
    last = last.withColumn("_slice", F.col("_slice") + 1)
    inner = Window.partitionBy(*keys, "_slice").orderBy(t, tie)
    df = df.join(last, [*keys, "_slice"], "left")
    prev = F.coalesce(F.lag(t).over(inner), F.col("_last"))
    df = df.withColumn("_start", F.when(prev.isNull() | (F.col(t) - prev >= gap), 1).otherwise(0))
    df = df.withColumn("_in", F.sum("_start").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    per_slice = df.groupBy(*keys, "_slice").agg(F.sum("_start").alias("_starts"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per_slice.select(*keys, "_slice", F.coalesce(F.sum("_starts").over(before), F.lit(0)).alias("_base"))
    return (
        df.join(base, [*keys, "_slice"])
        .withColumn(out, F.col("_in") + F.col("_base"))
        .drop("_slice", "_last", "_start", "_in", "_base")
    )
