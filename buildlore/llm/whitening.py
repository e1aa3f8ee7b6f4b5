"""Embedding whitening: principal directions of all vectors, and every vector along them with unit variance.

Entries become whole numbers, so their sums are exact. Each task reduces its centred rows to a triangular factor, block by block; factors of
neighbouring tasks are stacked and reduced again until one is left. The covariance itself is never formed, so small directions keep their
accuracy. The last factor is made bidiagonal, its singular values come from dqds and its vectors from twisted factorisations (`qd`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.llm import qd
from buildlore.llm.base import query, table
from buildlore.llm.texts import columns_of
from buildlore.session import drop_table, write_table

STEPS = 64  # of the grid, to one
OFFSET = 1_000_000
COMPONENTS = 32
BLOCK_NUMBERS = 1 << 18  # of a block of rows that is reduced at once
FAN_NUMBERS = 1 << 22  # of the factors that a task stacks
LARGEST = 2.0**61  # entries beyond it, on the grid, have no whole number of 64 bits
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Model:
    """What the vectors of one length are whitened by; `directions` has a row a component."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float


def on_grid(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole numbers) of the usable vectors of a list column, for each length by itself and in blocks of bounded size."""
    if not len(column):
        return
    at = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.slice(at[0], at[-1] - at[0])
    flat = flat.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # nulls become NaN
    at -= at[0]
    size = np.diff(at)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(flat * STEPS)
        bad = ~(np.abs(scaled) < LARGEST)
    told = np.r_[0, np.cumsum(bad)]
    fine = (told[at[1:]] == told[at[:-1]]) & (size > 0) & np.asarray(column.is_valid())
    for length in np.unique(size[fine]).tolist():
        rows = np.flatnonzero(fine & (size == length))
        step = max(1, BLOCK_NUMBERS // length)
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield part, scaled[at[part][:, None] + np.arange(length)].astype(np.int64) + OFFSET


def spread(x: np.ndarray, model: Model) -> np.ndarray:
    """n x - S, exactly: 64-bit numbers, or Python's where those do not hold it."""
    if float(np.abs(x).max(initial=0)) * model.n < 2.0**61:
        return x * model.n - np.array(model.sums, np.int64)
    return x.astype(object) * model.n - np.array(model.sums, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None where 64 bits do not hold one."""
    wide = np.ones(len(y), bool) if y.dtype == object else (y.astype(np.float64) ** 2).sum(axis=1) > 2.0**62
    out = [None] * len(y) if y.dtype == object else (y * y).sum(axis=1).tolist()
    for k in np.flatnonzero(wide).tolist():
        exact = sum(int(v) ** 2 for v in y[k])
        out[k] = exact if exact <= _LONG else None
    return out


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For every length how many vectors there are, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in on_grid(batch.column(0)):
                high = x >> 31
                part = (high.sum(axis=0).astype(object) << 31) + (x - (high << 31)).sum(axis=0).astype(object)
                part = np.r_[np.array([len(x)], object), part]
                total[x.shape[1]] = total.get(x.shape[1], 0) + part
        flat = [(length, place, str(v)) for length, values in total.items() for place, v in enumerate(values.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["length", "place", "told"])

    each = rows.mapInArrow(run, "length int, place int, told string")
    out: dict[int, list[int]] = {}
    # a row for each length and dimension
    for r in each.groupBy("length", "place").agg(F.sum(F.col("told").cast("decimal(38,0)")).alias("told")).orderBy("length", "place").collect():
        out.setdefault(r.length, []).append(int(r.told))
    return {length: (v[0], v[1:]) for length, v in out.items()}


def _stacked(factors: Iterator[np.ndarray], length: int) -> np.ndarray:
    held = np.zeros((0, length))
    for f in factors:
        held = np.linalg.qr(np.vstack([held, f]), mode="r")
    return held


def _factors(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """(length, part, factor): of each task and length the triangular factor of its centred rows."""
    models = {length: Model(n, s, np.zeros((0, length)), np.zeros(0), 0.0) for length, (n, s) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in on_grid(batch.column(0)):
                length = x.shape[1]
                centred = spread(x, models[length]).astype(np.float64) / models[length].n
                held[length] = _stacked(iter([held.get(length, np.zeros((0, length))), centred]), length)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([part] * len(held), pa.int64()), pa.array([f.tobytes() for f in held.values()], pa.binary())], ["length", "part", "factor"])

    return rows.mapInArrow(run, "length int, part bigint, factor binary")


def _combine(told: pa.Table) -> pa.Table:
    length, part = told["length"][0].as_py(), told["part"][0].as_py()
    order = np.argsort(told["own"].to_numpy(), kind="stable").tolist()
    factor = _stacked((np.frombuffer(told["factor"][k].as_py(), np.float64).reshape(-1, length) for k in order), length)
    return pa.table({"length": pa.array([length], pa.int32()), "part": pa.array([part], pa.int64()), "factor": pa.array([factor.tobytes()], pa.binary())})


def fit(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> dict[int, Model]:
    """For each length of the vectors in `column`, what whitens them: `most` components at most, and none without variance.

    Vectors that are null or empty, hold null or non-finite entries, or entries too large for the grid's 64 bits, are left out. Every length
    is fitted by itself. The driver holds one small model a length, a row of `most` numbers for each dimension.
    """
    rows = vectors.select(F.col(column).alias("_v"))
    sums = _sums(rows)
    if not sums:
        return {}
    told, place = write_table(_factors(rows, sums))
    try:
        parts = (told.agg(F.max("part")).collect()[0][0] or 0) + 1
        fan = max(2, FAN_NUMBERS // max(sums) ** 2)
        out = told
        while parts > 1:
            moved = out.select("length", F.col("part").alias("own"), F.floor(F.col("part") / fan).alias("part"), "factor")
            out = moved.groupBy("length", "part").applyInArrow(_combine, "length int, part bigint, factor binary")
            parts = -(-parts // fan)
        models = {}
        for r in out.collect():
            factor = np.frombuffer(r.factor, np.float64).reshape(-1, r.length)
            n, s = sums[r.length]
            squares, directions = qd.singular(factor, most)
            models[r.length] = Model(n, s, directions, squares / n, float((factor * factor).sum()) / n)
    finally:
        drop_table(vectors.sparkSession, place)
    return models


def _along(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    y = spread(x, model)
    return y, (y.astype(np.float64) / model.n) @ (model.directions / np.sqrt(model.variances)[:, None]).T


def identity_error(vectors: DataFrame, models: dict[int, Model], column: str = "embedding") -> dict[int, float]:
    """Of each length the largest entry, by size, of the whitened vectors' covariance less the identity, measured over all of them."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in on_grid(batch.column(0)):
                z = _along(x, shared.value[x.shape[1]])[1]
                total[x.shape[1]] = total.get(x.shape[1], 0.0) + np.vstack([z.sum(axis=0), z.T @ z])
        for length, values in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(values.size, length), pa.int32()), pa.array(np.arange(values.size), pa.int32()), pa.array(values.ravel())], ["length", "place", "told"])

    each = vectors.select(F.col(column).alias("_v")).mapInArrow(run, "length int, place int, told double")
    out: dict[int, list[float]] = {}
    for r in each.groupBy("length", "place").agg(F.sum("told").alias("told")).orderBy("length", "place").collect():
        out.setdefault(r.length, []).append(r.told)
    errors = {}
    for length, values in out.items():
        model, k = models[length], len(models[length].variances)
        values = np.array(values).reshape(k + 1, k) / model.n
        # the rows are centred already: the mean that is left is rounding
        errors[length] = float(np.abs(values[1:] - np.outer(values[0], values[0]) - np.eye(k)).max(initial=0.0))
    return errors


def whitened(vectors: DataFrame, models: dict[int, Model], column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, length, deviation, whitened) of every usable row: its exact distance figure and its coordinates along the components.

    `deviation` is the sum over dimensions of (n x - S) squared, null where it does not fit into 64 bits. Rows that `fit` leaves out are left
    out; repeated rows and null keys stay; other columns are not looked at.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    kind = vectors.schema[key].dataType.simpleString()
    names = ["vec_id", "length", "deviation", "whitened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, column = columns_of(batch, "_key", "_v")
            for rows, x in on_grid(column):
                y, z = _along(x, shared.value[x.shape[1]])
                stops = np.arange(len(z) + 1) * z.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1]), pa.int32()), pa.array(deviations(y), pa.int64()), lists], names)

    slim = vectors.select(F.col(key).alias("_key"), F.col(column).alias("_v"))
    return slim.mapInArrow(run, f"vec_id {kind}, length int, deviation bigint, whitened array<double>")


_ROWS = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    models = fit(vectors)
    errors = identity_error(vectors, models)
    names = [c.split()[0] for c in _ROWS.split(", ")]
    out = spark.createDataFrame([], _ROWS.format(vectors.schema["vec_id"].dataType.simpleString()))
    rows = whitened(vectors, models)
    figures = [(length, k + 1, m.n, float(v / m.trace), errors[length]) for length, m in models.items() for k, v in enumerate(m.variances)]
    if not figures:
        return out
    told = spark.createDataFrame(figures, "length int, component int, n bigint, explained double, identity_error double")
    each = rows.select("vec_id", "length", "deviation", F.posexplode("whitened").alias("place", "whitened")).withColumn("component", F.col("place") + 1)
    return each.join(F.broadcast(told), ["length", "component"]).select(*names)  # at most 32 rows a length of vectors
