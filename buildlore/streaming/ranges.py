"""Ordered folds of one busy key by many tasks.

A key's rows in order are cut into ranges of bounded size. What a range does to the state that enters it is a map with few pieces: it is built
without knowing that state, in parallel. Maps of neighbouring ranges are composed to maps of stretches; the state is carried over stretches, then
over the ranges of each stretch, and then every range is replayed from its own entry state, again in parallel. Only the carrying over
stretches is sequential, one row for `ROWS` times `FAN` rows. The rows of a range are kept as lists in one row, so they are shuffled once, when they are put in order.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from buildlore.session import drop_table, write_table

ROWS = 1 << 14  # of a range
FAN = 64  # ranges of a stretch
SAME = 1e-12  # tokens: a difference that is rounding


@dataclass(frozen=True)
class Spending:
    """What grants and requests of one cost do to a balance: it rises by `total` less the cost of the requests it can pay.

    A higher balance never pays for fewer requests, and at most one more for each cost it is higher by. So how many it pays for is told by
    rising `limits` at least one cost apart: as many as there are limits up to the balance.
    """

    cost: int
    total: int
    limits: np.ndarray

    @classmethod
    def of(cls, kinds: list[str], amounts: list[int], cost: int) -> Spending:
        total, limits = 0, np.zeros(0, np.float64)
        for kind, amount in zip(kinds, amounts):
            if kind != "request":
                total += amount
                continue
            # whoever pays for v requests so far pays for this one from cost * (v + 1) - total on
            own = cost * np.arange(1, len(limits) + 2) - total
            limits = np.minimum(np.r_[limits, np.inf], np.maximum(np.r_[-np.inf, limits], own))
        return cls(cost, total, limits)

    def after(self, state: int) -> int:
        return int(state + self.total - self.cost * int(np.searchsorted(self.limits, state, "right")))

    def then(self, other: Spending) -> Spending:
        """One map for both, in order. The limit for w requests is the least, over all ways to pay for v of them here, of the larger of two limits."""
        mine, theirs = np.r_[-np.inf, self.limits, np.inf], np.r_[-np.inf, other.limits, np.inf]
        n, m = len(self.limits), len(other.limits)
        w = np.arange(1, n + m + 1)
        low, high = np.maximum(0, w - m), np.minimum(n, w)
        rest = lambda v: theirs[w - v] - self.total + self.cost * v  # noqa: E731  falls as v rises, while `mine` rises
        a, b = low, high
        while (a < b).any():
            mid = (a + b) // 2
            right = mine[mid] >= rest(mid)
            a, b = np.where(right, a, mid + 1), np.where(right, mid, b)
        a = np.minimum(a, high)
        best = np.maximum(mine[a], rest(a))
        before = np.maximum(a - 1, low)
        return Spending(self.cost, self.total + other.total, np.minimum(best, np.maximum(mine[before], rest(before))))


@dataclass(frozen=True)
class Refill:
    """What requests at given times do to a bucket of tokens: pieces (from, value there, rising) of what is found at the first request, after its refill.

    Buckets that are full at the same time stay equal, and those less than one cost apart pay for nearly the same requests, so there are about
    as many pieces as the bucket holds costs. While no bucket holds more than a cost, each pays at most once while less than a cost flows in, and
    does so as soon as it can: these requests are as one, however many they are.
    """

    capacity: float
    rate: float
    first: float
    last: float
    pieces: tuple[tuple[float, float, bool], ...]

    @classmethod
    def of(cls, times: list[float], capacity: float, rate: float, cost: float = 1.0) -> Refill:
        gains = gained(np.asarray(times, np.float64), times[0], rate)
        flown, pieces, at = np.cumsum(gains), [(0.0, 0.0, True)], 0
        while at < len(gains):
            stop = at + 1
            if capacity >= 2 * cost and _most(pieces, capacity) <= cost:
                stop = max(stop, int(np.searchsorted(flown, flown[at] - gains[at] + cost)))
            pieces = _paid(_filled(pieces, float(gains[at:stop].sum()), capacity), cost, capacity)
            at = stop
        return cls(capacity, rate, times[0], times[-1], tuple(pieces))

    def _found(self, tokens: float, since: float) -> float:
        return min(self.capacity, tokens + max(0.0, self.first - since) * self.rate)

    def _value(self, found: float) -> float:
        low, value, rises = next(p for p in reversed(self.pieces) if p[0] <= found or p[0] == 0.0)
        return value + (found - low if rises else 0.0)

    def after(self, state: tuple[float, float] | None) -> tuple[float, float]:
        return self._value(self.capacity if state is None else self._found(*state)), self.last

    def then(self, other: Refill) -> Refill:
        out = []
        filled = _filled(list(self.pieces), max(0.0, other.first - self.last) * self.rate, self.capacity)
        for (low, value, rises), high in zip(filled, [*(p[0] for p in filled[1:]), self.capacity]):
            out.append((low, other._value(value), rises and _rising(other, value)))
            for begin, start, up in other.pieces:
                if rises and value < begin < value + high - low:
                    out.append((low + begin - value, start, up))
        return Refill(self.capacity, self.rate, self.first, other.last, tuple(_joined(out)))


@dataclass(frozen=True)
class Slots:
    """What requests at given times do to a window that takes `limit` of them in `seconds`: the times alone, of which only accepted ones are looked at.

    When the window is full, nothing happens until its oldest request leaves it, so a state is carried over a stretch by one search for each
    accepted request, however many are refused. Unlike the other maps this one is as long as its range; it is eight bytes a row.
    """

    limit: int
    seconds: float
    times: np.ndarray

    @classmethod
    def of(cls, times: list[float], limit: int, seconds: float) -> Slots:
        return cls(limit, seconds, np.array(times, np.float64))

    def after(self, state: tuple[float, ...]) -> tuple[float, ...]:
        live, at, n = list(state), 0, len(self.times)
        left = self.times - self.seconds  # what has left by then, compared as the fold does
        while at < n:
            gone = left[at]
            live = [x for x in live if x > gone]
            if len(live) < self.limit:
                live.append(float(self.times[at]))
                at += 1
            else:
                at = max(at + 1, int(np.searchsorted(left, live[0])))
        return tuple(x for x in live if x > left[-1]) if n else state

    def then(self, other: Slots) -> Slots:
        return Slots(self.limit, self.seconds, np.concatenate([self.times, other.times]))


def gained(times: np.ndarray, since: float, rate: float) -> np.ndarray:
    """The tokens that flow in before each request, the last one before them having been at `since`."""
    pause = np.diff(times, prepend=since)
    return np.where(pause > 0.0, pause, 0.0) * rate


def _most(pieces: list, capacity: float) -> float:
    """The most tokens that any bucket holds."""
    return max(value + (high - low if rises else 0.0) for (low, value, rises), high in zip(pieces, [*(p[0] for p in pieces[1:]), capacity]))


def _rising(other: Refill, found: float) -> bool:
    return next(p for p in reversed(other.pieces) if p[0] <= found or p[0] == 0.0)[2]


def _joined(pieces: list) -> list:
    """Without empty pieces, and without those that only go on as the one before does."""
    out = pieces[:1]
    for low, value, rises in pieces[1:]:
        a, start, up = out[-1]
        goes_on = rises == up and abs(value - start - (low - a if up else 0.0)) < SAME
        if low > a and not goes_on:
            out.append((low, value, rises))
    return out


def _filled(pieces: list, more: float, capacity: float) -> list:
    out = []
    for (low, value, rises), high in zip(pieces, [*(p[0] for p in pieces[1:]), capacity]):
        value += more
        if value >= capacity:
            out.append((low, capacity, False))
        else:
            out.append((low, value, rises))
            if rises and value + high - low >= capacity:
                out.append((low + capacity - value, capacity, False))
    return _joined(out)


def _paid(pieces: list, cost: float, capacity: float) -> list:
    out = []
    for (low, value, rises), high in zip(pieces, [*(p[0] for p in pieces[1:]), capacity]):
        if value >= cost:
            out.append((low, value - cost, rises))
        else:
            out.append((low, value, rises))
            if rises and value + high - low >= cost:
                out.append((low + cost - value, 0.0, True))
    return _joined(out)


def _frozen(text: str) -> Any:
    """A state as it was before it became text: lists are tuples."""
    value = json.loads(text)
    return tuple(value) if isinstance(value, list) else value


def _ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, `_part`, `_range`, and every other column as a list): ranges of at most `ROWS` rows of one key, in the order of key, part and range."""

    most = ROWS
    rest = [f for f in rows.schema.fields if f.name not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, held, size = TaskContext.get().partitionId(), 0, None, [], 0

        def packed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            edges = pa.array([0, whole.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(edges, whole[f.name].combine_chunks()) for f in rest]
            own = [whole[k].slice(0, 1).combine_chunks() for k in keys]
            return pa.RecordBatch.from_arrays([*own, pa.array([part], pa.int32()), pa.array([number], pa.int64()), *lists], [*keys, "_part", "_range", *(f.name for f in rest)])

        for batch in batches:
            batch = pa.Table.from_batches([batch]).combine_chunks().to_batches()[0] if batch.num_rows else batch
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            n = batch.num_rows
            new = np.zeros(max(0, n - 1), bool)
            for c in columns:
                new |= np.asarray(pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, max(0, n - 1))), False)) | (np.asarray(c.slice(1).is_null()) != np.asarray(c.slice(0, max(0, n - 1)).is_null()))
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), n] if n else []
            for a, b in zip(edges, edges[1:]):
                key = tuple(c[a].as_py() for c in columns)
                while a < b:
                    if held and (key != now or size == most):
                        yield packed()
                        number, held, size = number + 1, [], 0
                    now, taken = key, min(b - a, most - size)
                    held.append(batch.slice(a, taken))
                    a, size = a + taken, size + taken
        if held:
            yield packed()

    schema = StructType([*(rows.schema[k] for k in keys), StructField("_part", IntegerType()), StructField("_range", LongType()), *(StructField(f.name, ArrayType(f.dataType)) for f in rest)])
    return rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


Step = Callable[[Any, tuple], tuple[Any, tuple]]


def by_steps(step: Step) -> Callable:
    """`step` for all rows of a range: (state, a list for each column) to the state they leave and what is told of each row, a list for each output."""

    def run(state: Any, columns: list[pa.Array]) -> tuple[Any, list]:
        out = []
        for row in zip(*(c.to_pylist() for c in columns)):
            state, values = step(state, row)
            out.append(values)
        return state, list(zip(*out))

    return run


def fold_long_keys(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], step: Step, start: Any, outputs: str, summary: Callable, exact: bool, whole: Callable | None = None) -> DataFrame:
    """Every row plus the columns `step(state, inputs)` returns for it, for keys of many rows; `order` is unique in a key.

    `summary(*columns)` makes the map of a range from its inputs, with `after(state)` and `then(later map)`. `whole` is `step` for all rows of a
    range at once, as `by_steps` makes it. Where the map's arithmetic is not bit for bit the step's (`exact` is false), entries are corrected.
    """
    made: list[str] = []
    spark = rows.sparkSession
    whole = whole or by_steps(step)

    def keep(df: DataFrame) -> DataFrame:
        out, place = write_table(df)
        made.append(place)
        return out

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    ranged = keep(_ranges(rows, keys, order))
    names = [*keys, "_part", "_range"]
    slim = ranged.select(*names, *inputs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told in _each(batch):
                found = summary(*(_list(told, c).to_pylist() for c in inputs))
                yield pa.RecordBatch.from_arrays([*(_column(told, c) for c in names), pa.array([pickle.dumps(found)], pa.binary())], [*names, "_map"])

    maps = slim.mapInArrow(build, f"{kinds}, _part int, _range bigint, _map binary")
    numbered = Window.partitionBy(*keys).orderBy("_part", "_range")  # a row for each range
    maps = keep(maps.withColumn("_no", F.row_number().over(numbered) - 1).withColumn("_stretch", F.floor(F.col("_no") / FAN)))

    def compose(told: pa.Table) -> pa.Table:
        told = told.take(pa.array(np.argsort(told["_no"].to_numpy())))
        both = None
        for data in told["_map"].to_pylist():
            own = pickle.loads(data)  # noqa: S301  written by `build`
            both = own if both is None else both.then(own)
        return told.select([*keys, "_stretch"]).slice(0, 1).append_column("_map", pa.array([pickle.dumps(both)], pa.binary()))

    stretches = maps.groupBy(*keys, "_stretch").applyInArrow(compose, f"{kinds}, _stretch bigint, _map binary")
    key_at = list(range(len(keys)))

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, start
        for batch in batches:
            entries = []
            for row in batch.itertuples(index=False):
                key = tuple(row[i] for i in key_at)
                if key != now:
                    now, state = key, start
                entries.append(json.dumps(state))
                state = pickle.loads(row[-1]).after(state)  # noqa: S301
            yield batch.iloc[:, :-1].assign(_entry=entries)

    carried = stretches.repartition(*keys).sortWithinPartitions(*keys, "_stretch").mapInPandas(carry, f"{kinds}, _stretch bigint, _entry string")

    def descend(told: pa.Table) -> pa.Table:
        told = told.take(pa.array(np.argsort(told["_no"].to_numpy())))
        entries, state = [], _frozen(told["_entry"][0].as_py())
        for data in told["_map"].to_pylist():
            entries.append(json.dumps(state))
            state = pickle.loads(data).after(state)  # noqa: S301
        return told.select([*names, "_no"]).append_column("_entry", pa.array(entries, pa.string()))

    entries = maps.join(carried, [*keys, "_stretch"]).groupBy(*keys, "_stretch").applyInArrow(descend, f"{kinds}, _part int, _range bigint, _no int, _entry string")
    entries = keep(entries)
    if not exact:
        entries = _corrected(entries, slim, names, kinds, inputs, whole, start, keep)
    columns, given = [c.split()[0] for c in outputs.split(", ")], rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    types = [f.dataType for f in spark.createDataFrame([], outputs).schema.fields]
    arrow = [{"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64()}[t.simpleString()] for t in types]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told in _each(batch):
                lists = [_list(told, c) for c in inputs]
                _, out = whole(_frozen(_column(told, "_entry")[0].as_py()), lists)
                same = pa.array(np.zeros(len(lists[0]), np.int64))
                own = [_column(told, c).take(same) if c in keys else _list(told, c) for c in given]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, kind) for v, kind in zip(out, arrow))], [*given, *columns])

    own = entries.select("_part", "_range", "_entry")
    result, _ = write_table(ranged.join(own, ["_part", "_range"]).mapInArrow(replay, f"{fields}, {outputs}"))
    for place in made:
        drop_table(spark, place)
    return result


def _each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The ranges of a batch, one row each."""
    for x in range(batch.num_rows):
        yield batch.slice(x, 1)


def _column(told: pa.RecordBatch, name: str) -> pa.Array:
    return told.column(told.schema.get_field_index(name))


def _list(told: pa.RecordBatch, name: str) -> pa.Array:
    return _column(told, name).flatten()


def _corrected(entries: DataFrame, slim: DataFrame, names: list[str], kinds: str, inputs: list[str], whole: Callable, start: Any, keep: Callable) -> DataFrame:
    """The entries, each of them bit for bit what replaying the range before leaves.

    All ranges are replayed from their entries, in parallel. Of keys where a range does not leave the next one's entry, the ranges are then gone through
    in order, and those that another state enters are replayed from it: a rounding difference may go down a whole key, and no range can be told before
    the one before it. Such a pass holds a range at a time and reads only the inputs.
    """
    keys, own = names[:-2], names[-2:]

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told in _each(batch):
                state, _ = whole(_frozen(_column(told, "_entry")[0].as_py()), [_list(told, c) for c in inputs])
                yield pa.RecordBatch.from_arrays([*(_column(told, c) for c in own), pa.array([json.dumps(state)], pa.string())], [*own, "_left"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for told in _each(batch):
                key = tuple(_column(told, k)[0].as_py() for k in keys)
                if key != now:
                    now, state = key, json.dumps(start)
                yield pa.RecordBatch.from_arrays([*(_column(told, c) for c in [*names, "_no"]), pa.array([state], pa.string())], [*names, "_no", "_entry"])
                if state == _column(told, "_entry")[0].as_py():
                    state = _column(told, "_left")[0].as_py()
                else:
                    state = json.dumps(whole(_frozen(state), [_list(told, c) for c in inputs])[0])

    exits = keep(slim.join(entries.select(*own, "_entry"), own).select(*own, "_entry", *inputs).mapInArrow(leave, "_part int, _range bigint, _left string"))
    told = entries.join(exits, own)
    behind = told.select(*keys, (F.col("_no") + 1).alias("_no"), F.col("_left").alias("_enters"))
    wrong = keep(told.join(behind, [*keys, "_no"]).filter("_enters <> _entry").select(*keys).distinct())
    if wrong.isEmpty():
        return entries
    again = slim.select(*own, *inputs).join(told.join(wrong, keys, "left_semi"), own).select(*names, "_no", "_entry", "_left", *inputs)
    right = again.repartition(*keys).sortWithinPartitions(*keys, "_no").mapInArrow(follow, f"{kinds}, _part int, _range bigint, _no int, _entry string")
    return keep(entries.join(wrong, keys, "left_anti").select(*names, "_no", "_entry").unionByName(right))
