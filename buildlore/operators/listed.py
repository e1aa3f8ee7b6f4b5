"""Names matched inside the row of their attempt: both sides come as one list each, so that no name is ever a row of a shuffle.

Lists are opened as Arrow tables in slices of bounded size; one attempt with more names than a slice is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Entries of both sides in a slice, and pairs of entries with one name that are held at once.
SLICE = 1 << 17
PAIRS = 1 << 20
NONE = np.iinfo(np.int64).max
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def is_listed(df: DataFrame) -> bool:
    """Whether symbols come as lists: (attempt, symbols) with the columns of the rows as fields, an attempt in one row."""
    return isinstance(df.schema["symbols"].dataType, T.ArrayType) if "symbols" in df.columns else False


def fields_of(df: DataFrame, *names: str) -> list[T.StructField]:
    kinds = df.schema["symbols"].dataType.elementType
    return [T.StructField(n, kinds[n].dataType) for n in names if n in kinds.names]


def meet(expected: DataFrame, submitted: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], fields: list[T.StructField]) -> DataFrame:
    """What `run` makes of batches (attempt, expected, submitted), a row per attempt of either side; each side has an attempt once."""
    # a full join, as any other would filter one side before its shuffle, which both may share
    both = expected.withColumnRenamed("symbols", "expected").join(submitted.withColumnRenamed("symbols", "submitted"), "attempt", "full")
    attempt = T.StructField("attempt", expected.schema["attempt"].dataType)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield run(part)
            batch = part = None  # the next one is read before these names are given away
            _release()

    return both.select("attempt", "expected", "submitted").mapInArrow(each, T.StructType([attempt, *fields]))


def _release() -> None:
    """Give what Arrow and numpy have freed back to the machine; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(_lengths(batch.column("expected")) + _lengths(batch.column("submitted")))
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _opened(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Of every entry its row, and the entries."""
    return np.repeat(np.arange(len(lists)), _lengths(lists)), lists.flatten()


def _codes(*columns: pa.Array) -> tuple[list[np.ndarray], int]:
    """Equal values get equal numbers, nulls -1; and how many numbers there are."""
    told = pa.concat_arrays(columns).dictionary_encode()
    codes = np.asarray(pc.fill_null(told.indices, -1)).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1]), max(len(told.dictionary), 1)


def _keys(at: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    return np.where(codes < 0, -1, at * n + codes)


def _whole(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, and where they are null."""
    return np.asarray(pc.fill_null(values, 0)).astype(np.int64), np.asarray(values.is_null())


def _three(values: pa.Array) -> np.ndarray:
    """1 for true, 0 for false, -1 for null."""
    return np.asarray(pc.fill_null(pc.cast(values, pa.int8()), -1)).astype(np.int8)


def _places(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(np.where(values == NONE, 0, values), mask=values == NONE).cast(kind)


def _shape(entries: pa.StructArray) -> tuple[np.ndarray, ...]:
    """Kind (0 class, 1 function or method, 2 anything else), argument count and where it is null, whether bound."""
    kind, lists = entries.field("kind"), entries.field("args")
    is_class = np.asarray(pc.fill_null(pc.equal(kind, pa.scalar("class", kind.type)), False))
    called = np.asarray(pc.is_in(kind, pa.array(["function", "method"], kind.type)))
    at, names = np.repeat(np.arange(len(lists)), _lengths(lists)), lists.flatten()
    bound = np.zeros(len(entries), bool)
    bound[at[np.asarray(pc.is_in(names, pa.array(["self", "cls"], names.type)))]] = True
    return np.where(is_class, 0, np.where(called, 1, 2)), *_whole(entries.field("arg_count")), bound


def _pairs(key: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of equal keys on both sides, in blocks of about `PAIRS`; negative keys equal nothing."""
    order = np.argsort(other, kind="stable")
    have = other[order]
    first = np.searchsorted(have, key, "left")
    n = np.where(key < 0, 0, np.searchsorted(have, key, "right") - first)
    ends = np.cumsum(n)
    start = 0
    while start < len(key):
        done = ends[start] - n[start]
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        m = n[start:stop]
        i = np.repeat(np.arange(start, stop), m)
        yield i, order[np.arange(done, ends[stop - 1]) + (first - ends + n)[i]]
        start = stop


def compared(batch: pa.RecordBatch, extra: bool) -> pa.RecordBatch:
    """(attempt, pos, name, match_idx, stub_idx) of what is expected, or (attempt, idx, name, kind) of what nobody expects."""
    attempt, (e_at, e), (s_at, s) = batch.column("attempt"), _opened(batch.column("expected")), _opened(batch.column("submitted"))
    (e_name, s_name), n = _codes(e.field("name"), s.field("name"))
    place = [c for c in ("pos", "name") if e.type.get_field_index(c) >= 0]
    (pos,), n_pos = _codes(e.field(place[0]))
    e_key, s_key = _keys(e_at, e_name, n), _keys(s_at, s_name, n)
    e_kind, e_args, e_any, e_bound = _shape(e)
    s_kind, s_args, s_any, s_bound = _shape(s)
    idx, no_idx = _whole(s.field("idx"))
    idx[no_idx] = NONE
    is_stub = _three(s.field("is_stub"))
    # what is equal in attempt, name and place is one expectation
    _, first, one = np.unique((e_at * (n + 1) + e_name + 1) * (n_pos + 1) + pos + 1, return_index=True, return_inverse=True)
    match, stub = np.full(len(first), NONE), np.full(len(first), NONE)
    for i, j in _pairs(e_key, s_key):
        a, b = e_args[i], s_args[j]
        count = (a == b) | (e_bound[i] & (a - 1 == b)) | (s_bound[j] & (b - 1 == a))
        same = ((e_kind[i] == 2) | (e_kind[i] == s_kind[j])) & (e_any[i] | s_any[j] | count)
        for out, which in ((match, 0), (stub, 1)):
            hit = same & (is_stub[j] == which)
            np.minimum.at(out, one[i[hit]], idx[j[hit]])
    if extra:
        used = np.zeros(len(s), bool)
        for i, j in _pairs(e_key, s_key):
            used[j[(match[one[i]] == idx[j]) & ~no_idx[j]]] = True
        left = np.flatnonzero(~used)
        return pa.RecordBatch.from_arrays([attempt.take(pa.array(s_at[left])), *(s.field(c).take(pa.array(left)) for c in ("idx", "name", "kind"))], ["attempt", "idx", "name", "kind"])
    at, kind = pa.array(first), s.field("idx").type
    return pa.RecordBatch.from_arrays([attempt.take(pa.array(e_at[first])), *(e.field(c).take(at) for c in place), _places(match, kind), _places(stub, kind)],
                                      ["attempt", *place, "match_idx", "stub_idx"])


def graded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(attempt, full_name, is_trivial, got): whether what answers to an expected name is trivial, null where nothing does."""
    attempt, (e_at, e), (s_at, s) = batch.column("attempt"), _opened(batch.column("expected")), _opened(batch.column("submitted"))
    (e_full, e_name, s_full, s_name), n = _codes(*(side.field(c) for side in (e, s) for c in ("full_name", "name")))
    (idx, no_idx), trivial = _whole(s.field("idx")), _three(s.field("is_trivial"))

    def known(codes: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        """Every key and its value at the last place, or the first if `sign` is negative."""
        key = np.where(no_idx, -1, _keys(s_at, codes, n))
        order = np.lexsort((sign * idx, key))
        key = key[order]
        last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
        return key[last], trivial[order[last]]

    def told(key: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(key), -1, np.int8)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (key >= 0), values[at], -1)

    by_full, by_name = known(s_full, 1), known(s_name, -1)

    def asked(codes: np.ndarray) -> np.ndarray:
        key = _keys(e_at, codes, n)
        found = told(key, *by_full)
        return np.where(found < 0, told(key, *by_name), found)

    got = asked(e_full)
    got = np.where(got < 0, asked(e_name), got)
    return pa.RecordBatch.from_arrays([attempt.take(pa.array(e_at)), e.field("full_name"), e.field("is_trivial"), pa.array(got > 0, mask=got < 0)],
                                      ["attempt", "full_name", "is_trivial", "got"])
