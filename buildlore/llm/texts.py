"""Whole-batch text hashing with numpy: word shingles, byte n-grams and MinHash over Arrow string columns.

All hashes are fixed functions of the bytes, the same in every process. Texts are taken in slices of bounded size, so a batch's memory does
not depend on how many rows Spark puts into it; one text longer than a slice is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that low and high bits are equally good."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > SLICE_BYTES * 2:
        return _run(_BASE, n), _run(_INVERSE, n)
    if not _POWERS:
        _POWERS["up"], _POWERS["down"] = _run(_BASE, SLICE_BYTES * 2), _run(_INVERSE, SLICE_BYTES * 2)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _run(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def columns_of(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `limit` bytes together, one row at least."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64))
    start = 0
    while start < len(text):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield start, stop
        start = stop
    release()


def release() -> None:
    """Give what Arrow and numpy have freed back to the machine; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after the other, and where each text starts; a null is an empty text."""
    text = pc.fill_null(text, "")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, at, data = text.buffers()
    at = np.frombuffer(at, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end of every word; words are runs of bytes other than ASCII white space."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    gap = _SPACE[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = gap[:-1]
    edge[at] = True
    starts = np.flatnonzero(edge[:n] & ~gap)
    edge[:] = True
    edge[: n - 1] = gap[1:]
    edge[at[1:][at[1:] > 0] - 1] = True
    ends = np.flatnonzero(edge[:n] & ~gap) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts])
    return h, np.searchsorted(at, starts, side="right") - 1, starts, ends


def shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of `k` words; a text of fewer words has one shingle, of all its words."""
    n = len(h)
    if not n:
        return h, doc
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[first, n])
    ahead = np.zeros(n, np.uint64)
    padded = np.r_[h, np.zeros(k, np.uint64)]
    end = np.repeat(first + size, size)
    at = np.arange(n)
    scale = np.uint64(1)
    for j in range(k):
        ahead += np.where(at + j < end, padded[j : n + j] * scale, np.uint64(0))
        scale = np.uint64(int(scale) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    keep = (at + k <= end) | ((at == np.repeat(first, size)) & np.repeat(size < k, size))
    return mix(ahead[keep]), doc[keep]


def grams(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of `n` bytes inside a text."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(data) - n + 1
    h = np.zeros(count, np.uint64)
    for j in range(n):
        h *= np.uint64(0x100000001B3)
        h += data[j : count + j]
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    inside = doc[:count] == doc[n - 1 :]
    return mix(h[inside]), doc[:count][inside]


def sets(h: np.ndarray, doc: np.ndarray, n_docs: int) -> list[np.ndarray]:
    """The sorted distinct hashes of every text; `doc` does not fall."""
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def minhash(h: np.ndarray, doc: np.ndarray, n_docs: int, size: int, seed: int = 1) -> np.ndarray:
    """(texts, size) minima of `size` random orders of the hashes; rows of texts without hashes hold the largest value."""
    out = np.full((n_docs, size), 0xFFFFFFFF, np.uint32)
    if not len(h):
        return out
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    who = doc[first]
    for j in range(size):
        a, b = mix(np.array([seed * 1000003 + 2 * j, seed * 1000003 + 2 * j + 1], np.uint64) + np.uint64(0x5851F42D4C957F2D))
        out[who, j] = np.minimum.reduceat(((h * (a | np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32), first)
    return out
