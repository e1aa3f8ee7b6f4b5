"""Suffix ranks of many strings by the difference-cover method, with sorts and prefix counts that Spark spreads.

Of the suffixes of a string those at positions 1 and 2 modulo 3 are sampled. Triples of symbols are sorted and named by how many are smaller; the
names of each class are a string of a third of the length, whose suffixes are ranked the same way; and the remaining suffixes are merged in by two
sorts, against the samples of either class. No sort is by a whole key: rows are dealt by ranges of the sort key, each task counts along its own
range, and the totals of the ranges, one row each, are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from buildlore.session import drop_table, write_table

WIDTH = 1 << 16  # symbols of a string that a window sees together
PLACE = ["text", "lane", "at"]


def scratch(df: DataFrame, made: list[str]) -> DataFrame:
    """`df` written once to the shared folder; `made` remembers where. Without dictionaries: hashes and ranks hardly repeat, and looking each up costs a third of the writing."""
    out, place = write_table(df, **{"parquet.enable.dictionary": "false"})
    made.append(place)
    return out


def _drop(df: DataFrame, made: list[str]) -> None:
    """Drop the tables of `made`, which nothing reads any more."""
    for place in made:
        drop_table(df.sparkSession, place)
    made.clear()


def placed(df: DataFrame, keys: list[str], flags: list[str], keep: list[str], made: list[str]) -> tuple[DataFrame, int, int]:
    """`keep` of every row and, as `before_<flag>`, how many rows with the flag (0 or 1) have a smaller key; the numbers of rows and of distinct keys."""
    names = [f"before_{f}" for f in flags]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, begun, last, rows, groups = [0] * len(flags), [0] * len(flags), None, 0, 0
        part = TaskContext.get().partitionId()
        types = []
        for batch in batches:
            n = batch.num_rows
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            types = [column(c).type for c in keep]
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                new[1:] |= np.asarray(pc.not_equal(column(k).slice(1), column(k).slice(0, n - 1)))
            new[0] = last is None or any(column(k)[0].as_py() != v for k, v in zip(keys, last))
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            counted = []
            for f, flag in enumerate(flags):
                value = column(flag).to_numpy().astype(np.int64)
                smaller = total[f] + np.cumsum(value) - value
                smaller = np.where(start >= 0, smaller[np.maximum(start, 0)], begun[f])
                counted.append(smaller)
                begun[f], total[f] = int(smaller[-1]), total[f] + int(value.sum())
            last, rows, groups = [column(k)[n - 1].as_py() for k in keys], rows + n, groups + int(new.sum())
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*(column(c) for c in keep), *(pa.array(c, pa.int64()) for c in counted), pa.array(np.full(n, part), pa.int32()), none, none], [*keep, *names, "range", "rows", "groups"])
        if rows:
            ends = [*(pa.nulls(1, t) for t in types), *(pa.array([t], pa.int64()) for t in total), pa.array([part], pa.int32()), pa.array([rows], pa.int64()), pa.array([groups], pa.int64())]
            yield pa.RecordBatch.from_arrays(ends, [*keep, *names, "range", "rows", "groups"])

    fields = [df.schema[c] for c in keep] + [StructField(c, LongType()) for c in names]
    fields = [StructField(f.name, f.dataType) for f in fields] + [StructField("range", IntegerType()), StructField("rows", LongType()), StructField("groups", LongType())]
    slim = df.select(*dict.fromkeys([*keep, *keys, *flags]))
    told = scratch(slim.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, StructType(fields)), made)
    ends = told.filter("rows is not null")
    size = ends.agg(F.sum("rows"), F.sum("groups")).collect()[0]
    along = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = ends.select("range", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"base_{c}") for c in names])
    out = told.filter("rows is null").join(F.broadcast(base), "range")
    return out.select(*keep, *[(F.col(c) + F.col(f"base_{c}")).alias(c) for c in names]), size[0] or 0, size[1] or 0


def _ahead(df: DataFrame, columns: list[str], steps: int = 2) -> DataFrame:
    """Each symbol with the values of `columns` one and two symbols on (0 beyond the end), as `<column>1` and so on; rows of one place are one."""
    block = F.floor(F.col("at") / WIDTH)
    guest = (F.col("at") % WIDTH < steps) & (F.col("at") >= WIDTH)
    dealt = df.select("*", F.explode(F.when(guest, F.array(block, block - 1)).otherwise(F.array(block))).alias("block")).repartition("text", "lane", "block")
    whole = dealt.groupBy("text", "lane", "block", "at").agg(*[F.max(c).alias(c) for c in columns])
    along = Window.partitionBy("text", "lane", "block").orderBy("at")
    out = whole.select("*", *[F.coalesce(F.lead(c, s).over(along), F.lit(0)).cast("bigint").alias(f"{c}{s}") for c in columns for s in range(1, steps + 1)])
    return out.filter(block == F.col("block")).drop("block")


def _suffixes(symbols: DataFrame, depth: int, made: list[str]) -> DataFrame:
    """(text, lane, at, rank) of `symbols` (text, lane, at, name): one more than the number of smaller suffixes, by `depth` symbols at least."""
    kind, used = F.col("at") % 3, []
    sample = _ahead(symbols, ["name"]).filter(kind > 0).withColumn("one", F.lit(1))
    named, rows, names = placed(sample, ["name", "name1", "name2"], ["one"], PLACE, used)
    named = named.select(*PLACE, (F.col("before_one") + 1).alias("name"))
    if names == rows or depth <= 3:
        ranked = named.withColumnRenamed("name", "rank")
    else:
        shorter = named.select("text", (F.col("lane") * 2 + kind - 1).cast("int").alias("lane"), F.floor(F.col("at") / 3).alias("at"), "name")
        told = _suffixes(shorter, -(-depth // 3), used)
        ranked = told.select("text", F.floor(F.col("lane") / 2).cast("int").alias("lane"), (F.col("at") * 3 + F.col("lane") % 2 + 1).alias("at"), "rank")
    both = symbols.select(*PLACE, "name", F.lit(None).cast("bigint").alias("rank")).unionByName(ranked.select(*PLACE, F.lit(None).cast("bigint").alias("name"), "rank"))
    near = scratch(_ahead(both, ["name", "rank"]), used)
    first = near.filter(kind < 2).select(*PLACE, "name", "rank1", (kind == 0).cast("int").alias("rest"), (kind == 1).cast("int").alias("sampled"))
    second = near.filter(kind != 1).select(*PLACE, "name", "name1", "rank2", (kind == 0).cast("int").alias("rest"), (kind == 2).cast("int").alias("sampled"))
    a, _, _ = placed(first, ["name", "rank1"], ["rest", "sampled"], PLACE, used)
    b, _, _ = placed(second, ["name", "name1", "rank2"], ["rest", "sampled"], PLACE, used)
    told = [
        a.select(*PLACE, (F.col("before_rest") + F.when(kind == 0, F.col("before_sampled")).otherwise(0)).alias("smaller")),
        b.select(*PLACE, F.when(kind == 0, F.col("before_sampled")).otherwise(F.col("before_rest")).alias("smaller")),
        ranked.select(*PLACE, (F.col("rank") - 1).alias("smaller")),
    ]
    out = scratch(told[0].unionByName(told[1]).unionByName(told[2]).groupBy(*PLACE).agg((F.sum("smaller") + 1).alias("rank")), made)
    _drop(out, used)
    return out


def suffix_ranks(symbols: DataFrame, depth: int, made: list[str]) -> DataFrame:
    """(text, at, rank) of `symbols` (text bigint, at bigint, word of any sortable type): the order of the suffixes of each text's words.

    Positions of a text are 0, 1, 2 and so on; suffixes of all texts are ranked together, a rank being one more than the number of smaller suffixes.
    Suffixes that agree in `depth` words, or to their ends, may share a rank. A place that is told twice is one. `made` takes the tables written
    on the way, which the caller drops when the result has been read.
    """
    used: list[str] = []
    named, _, _ = placed(symbols.withColumn("one", F.lit(1)), ["word"], ["one"], ["text", "at"], used)
    out = _suffixes(named.select("text", F.lit(0).alias("lane"), F.col("at").cast("bigint").alias("at"), (F.col("before_one") + 1).alias("name")), depth, made)
    _drop(out, used)
    return out.drop("lane")
