"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping pieces. A piece of m characters that occurs in a document with at most e edits shares at least
m - q + 1 - q*e of its q-grams with it, all on diagonals (document position minus item position) that lie within e of one another. So shared
q-grams are counted in overlapping bands of diagonals; bands that reach the bound are retained, and their pieces verified by an alignment
inside the band. The benchmark is the stated query set: it is read in blocks of bounded size, each held by every task that scans documents,
so documents are neither shuffled nor exploded into q-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from buildlore.llm import texts as T
from buildlore.llm.base import fresh, query, table

Q = 10
PIECE = 100  # characters, of text in lower case whose other characters than letters and digits are single spaces
STRIDE = 50
RUN_WORDS = 13  # in a row, from any word of an item on, are a piece too
EDITS = 0.08  # of a piece's characters
LEAST_SHARED = 10  # q-grams that a piece shares with a text at its most edits, where it is long enough; shorter ones may have fewer edits
ALIGNED = 4096  # pieces that are aligned together
BLOCK_CHARS = 4_000_000  # of the benchmark, that a task holds at a time


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The lower-case form of each character of the basic plane, and whether it is a letter or digit."""
    lower, word = np.arange(65536, dtype=np.uint32), np.zeros(65536, bool)
    for c in range(65536):
        small = chr(c).lower()
        lower[c] = ord(small) if len(small) == 1 else c
        word[c] = chr(c).isalnum()
    return lower, word


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts as compared, where each text starts among them, and where each came from in its own text."""
    lower, word = _tables()
    at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    basic = raw < 65536
    code = np.where(basic, raw, 0)
    inside = word[code] | ~basic
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(raw)]] = False
    kept = np.flatnonzero(inside | before)
    chars = np.where(inside, np.where(basic, lower[code], raw), 32)[kept].astype(np.uint32)
    new = np.searchsorted(kept, at)
    return chars, new, kept - np.repeat(at[:-1], np.diff(new))


def _qgrams(chars: np.ndarray) -> np.ndarray:
    n = max(0, len(chars) - Q + 1)
    h = np.zeros(n, np.uint64)
    for j in range(Q):
        h *= np.uint64(0x100000001B3)
        h += chars[j : n + j]
    return T.mix(h)


def budget(m: int) -> int:
    """Edits a piece of m characters may have: a share of them, and few enough for the lemma's bound to stay selective."""
    return max(0, min(int(m * EDITS), (m - Q + 1 - LEAST_SHARED) // Q))


@dataclass
class Index:
    """A block of the benchmark: its q-grams in order, and the pieces of each item. Items too short for a q-gram are words to look up."""

    ids: list[int]
    chars: list[np.ndarray]
    pieces: list[list[tuple[int, int]]] = field(default_factory=list)  # (start, length) in each item
    grams: np.ndarray | None = None
    items: np.ndarray | None = None
    offsets: np.ndarray | None = None
    seen: np.ndarray | None = None

    def __post_init__(self):
        grams, items, offsets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, c in enumerate(self.chars):
            m = min(PIECE, len(c))
            if m < Q:
                self.short.setdefault(m, {}).setdefault(c.tobytes(), []).append(i)
            begin = [0, *(np.flatnonzero(c == 32) + 1).tolist(), len(c) + 1]
            runs = {(s, stop - 1 - s) for s, stop in zip(begin, begin[RUN_WORDS:])}
            self.pieces.append(sorted({(s, m) for s in {*range(0, len(c) - m + 1, STRIDE), len(c) - m}} | runs))
            g = _qgrams(c)
            grams.append(g)
            items.append(np.full(len(g), i))
            offsets.append(np.arange(len(g)))
        grams, items, offsets = np.concatenate(grams), np.concatenate(items), np.concatenate(offsets)
        order = np.argsort(grams, kind="stable")
        self.grams, self.items, self.offsets = grams[order], items[order], offsets[order]
        self.seen = np.zeros(1 << 22, bool)  # a first look that most q-grams of documents fail
        self.seen[self.grams & np.uint64((1 << 22) - 1)] = True
        self.edits = [np.array([budget(m) for _, m in p]) for p in self.pieces]
        self.bounds = [np.array([m - Q + 1 for _, m in p]) - Q * e for p, e in zip(self.pieces, self.edits)]
        self.least = np.array([max(1, b.min()) for b in self.bounds])
        self.wide = max([int(e.max()) for e in self.edits], default=0) + 1


def aligned_all(pieces: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, high: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of each piece in its text: the fewest edits that turn it into a part of the text, start less position within low..high, and where that part ends.

    All tables grow together, a row of each at a time. A piece that needs more than `most` edits is given up; it is told as `most` and one.
    """
    n = len(pieces)
    edits, ends = most + 1, np.zeros(n, np.int64)
    order = np.argsort([len(p) for p in pieces], kind="stable")
    size = np.array([len(pieces[k]) for k in order])
    width = int((high - low).max()) + 1 if n else 0
    longest = int(size[-1]) if n else 0
    letters = np.zeros((n, longest), np.uint32)
    seen = np.full((n, longest + width), 0xFFFFFFFF, np.uint32)
    for row, k in enumerate(order):
        letters[row, : size[row]] = pieces[k]
        a, b = max(0, int(low[k])), min(len(texts[k]), int(low[k]) + longest + width)
        if b > a:
            seen[row, a - low[k] : b - low[k]] = texts[k][a:b]
    step = np.arange(width)
    low, high, most, length = low[order], high[order], most[order], np.array([len(texts[k]) for k in order])
    start, beyond = step + low[:, None], step > (high - low)[:, None]
    row = np.where((start >= 0) & (start <= length[:, None]) & ~beyond, 0, longest + 1)
    for i in range(longest):
        new = row + (seen[:, i : i + width] != letters[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
        row[beyond] = longest + 1
        done = size == i + 1
        if done.any():
            best = row[done].argmin(axis=1)
            found = row[done, :][np.arange(len(best)), best]
            edits[order[done]] = np.minimum(found, most[done] + 1)
            ends[order[done]] = i + 1 + low[done] + best
        if i % 6 == 5 or done.any():  # the fewest edits never fall from row to row
            live = ~done & (row.min(axis=1) <= most)
            if not live.all():
                order, size, low, most, letters, seen, beyond, row = (x[live] for x in (order, size, low, most, letters, seen, beyond, row))
            if not len(order):
                break
    return edits, ends


def aligned(piece: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, end) of one piece, however many edits it needs."""
    edits, ends = aligned_all([piece], [text], np.array([low]), np.array([high]), np.array([len(piece) + 1]))
    return int(edits[0]), int(ends[0])


def _candidates(hits_in: np.ndarray, index: Index, item: int) -> np.ndarray:
    """The pieces of an item that have enough of the q-grams that a band shares."""
    places, ordered = np.array(index.pieces[item]), np.sort(hits_in)
    held = np.searchsorted(ordered, places.sum(axis=1) - Q, "right") - np.searchsorted(ordered, places[:, 0], "left")
    return np.flatnonzero(held >= np.maximum(1, index.bounds[item]))


def _words_of(chars: np.ndarray, at: np.ndarray, index: Index):
    """(text, item, start, end) of items too short for a q-gram, where they stand as whole words."""
    for m, known in index.short.items():
        n = len(chars) - m + 1
        if not m or n < 1:
            continue
        begins = np.zeros(len(chars) + 1, bool)
        begins[at[:-1]] = True
        begins[1:] |= chars == 32
        ends = np.zeros(len(chars) + 1, bool)
        ends[at[1:]] = True
        ends[:-1] |= chars == 32
        spot = np.flatnonzero(begins[:n] & ends[m:])
        doc = np.searchsorted(at, spot, "right") - 1
        spot = spot[spot + m <= at[doc + 1]]
        rows = np.lib.stride_tricks.sliding_window_view(chars, m)[spot]
        heads = [int(np.frombuffer(word, np.uint32)[0]) for word in known]
        for k in np.flatnonzero(np.isin(rows[:, 0], heads)).tolist():
            for i in known.get(rows[k].tobytes(), ()):
                d = int(np.searchsorted(at, spot[k], "right")) - 1
                yield d, i, int(spot[k] - at[d]), int(spot[k] - at[d]) + m


def matches(texts: list[str], index: Index, first_only: bool = False) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text, item, pieces found, pieces, least edits, start, end) of each text and item with a verified piece; positions in the text as given.

    With `first_only`, a text's pieces need not be aligned any more once one of them is found unedited: the texts are right, the numbers need not be.
    """
    chars, at, source = normalise(texts)
    found: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}
    held: set[int] = set()

    def add(d: int, i: int, k: int, edits: int, start: int, end: int) -> None:
        own = found.setdefault((d, i), {})
        held.add(d)
        if k not in own or (edits, start) < own[k][:2]:
            own[k] = (edits, start, end)

    for d, i, start, end in _words_of(chars, at, index):
        add(d, i, 0, 0, start, end)
    open_pieces = []
    for d, i, low, pos, offset in _bands(chars, at, index):
        if first_only and d in held:
            continue
        text, own = chars[at[d] : at[d + 1]], index.chars[i]
        for k in _candidates(offset, index, i).tolist():
            s, m = index.pieces[i][k]
            inside = np.flatnonzero((offset >= s) & (offset <= s + m - Q))[0]
            start = int(pos[inside] - offset[inside]) + s
            if 0 <= start and start + m <= len(text) and (text[start : start + m] == own[s : s + m]).all():
                add(d, i, k, 0, start, start + m)
            elif index.edits[i][k]:
                open_pieces.append((d, i, k, s + low - int(index.edits[i][k]), s + low + 2 * index.wide - 1 + int(index.edits[i][k])))
    if first_only:
        open_pieces = [p for p in open_pieces if p[0] not in held]
    for x in range(0, len(open_pieces), ALIGNED):
        part = open_pieces[x : x + ALIGNED]
        most = np.array([index.edits[i][k] for _, i, k, _, _ in part])
        own = [index.chars[i][slice(s, s + m)] for _, i, k, _, _ in part for s, m in [index.pieces[i][k]]]
        edits, ends = aligned_all(own, [chars[at[d] : at[d + 1]] for d, *_ in part], np.array([p[3] for p in part]), np.array([p[4] for p in part]), most)
        for (d, i, k, _, _), piece, e, end in zip(part, own, edits.tolist(), ends.tolist()):
            if e <= index.edits[i][k]:
                add(d, i, k, e, max(0, end - len(piece)), min(end, int(at[d + 1] - at[d])))
    out = []
    for (d, i), own in sorted(found.items()):
        origin = source[at[d] : at[d + 1]]
        start, end = min(v[1] for v in own.values()), max(v[2] for v in own.values())
        out.append((d, i, len(own), len(index.pieces[i]), min(v[0] for v in own.values()), int(origin[start]), int(origin[end - 1]) + 1))
    return out


def _bands(chars: np.ndarray, at: np.ndarray, index: Index):
    """(text, item, lowest diagonal, places in the text, places in the item) of the bands that share as many q-grams as a piece of the item needs."""
    if len(chars) < Q or not len(index.grams):
        return
    h = _qgrams(chars)
    where = np.flatnonzero(index.seen[h & np.uint64((1 << 22) - 1)])
    lo, hi = np.searchsorted(index.grams, h[where], "left"), np.searchsorted(index.grams, h[where], "right")
    where, lo, hi = where[hi > lo], lo[hi > lo], hi[hi > lo]
    doc = np.searchsorted(at, where, "right") - 1
    inside = where + Q <= at[doc + 1]
    where, lo, hi, doc = where[inside], lo[inside], hi[inside], doc[inside]
    if not len(where):
        return
    size = hi - lo
    entry = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    doc, pos = np.repeat(doc, size), np.repeat(where - at[doc], size)
    item, offset = index.items[entry], index.offsets[entry]
    band = (pos - offset) // index.wide
    base = int(band.min()) - 1
    spread = int(band.max()) - base + 1
    key = (doc * len(index.ids) + item) * spread + (band - base)
    # a hit counts in its own band and in the one that overlaps it from below
    both = np.concatenate([key, key - 1])
    names, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
    enough = count >= index.least[(names // spread) % len(index.ids)]
    keep = np.flatnonzero(enough[inverse])
    keep = keep[np.argsort(inverse[keep], kind="stable")]
    for part in np.split(keep, np.flatnonzero(np.diff(inverse[keep])) + 1) if len(keep) else []:
        name = int(names[inverse[part[0]]])
        rows = part % len(key)
        rows = rows[np.argsort(pos[rows], kind="stable")]
        yield name // spread // len(index.ids), name // spread % len(index.ids), (name % spread + base) * index.wide, pos[rows], offset[rows]


def indexes(benchmark: DataFrame) -> list[Index]:
    """The benchmark in blocks of `BLOCK_CHARS` characters, about; a larger benchmark makes more blocks, not larger ones."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    blocks = -(-total // BLOCK_CHARS)
    out = []
    for k in range(blocks):
        rows = sorted(map(tuple, items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()))
        chars, at, _ = normalise([t for _, t in rows])
        own = [chars[a:b] if b == a or chars[b - 1] != 32 else chars[a : b - 1] for a, b in zip(at[:-1], at[1:])]
        kept = [(i, c) for (i, _), c in zip(rows, own) if len(c)]
        if kept:
            out.append(Index([i for i, _ in kept], [c for _, c in kept]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, pieces, of_pieces, edits, start, end) of every document and item of which a piece occurs in it.

    `pieces` of the item's `of_pieces` pieces were found, the best of them with `edits` edits; start and end bound them all, in characters
    of the text as given. Null texts and items hold nothing, and items without letters and digits are not looked for; items of under `Q`
    characters are found as whole words. Equal rows of the result are one, so repeated documents and items do not repeat it. Documents with a null
    key are told with it. Extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_key {kind}, item_id bigint, pieces int, of_pieces int, edits int, start int, end int"
    names = [c.split()[0] for c in schema.split(", ")]
    slim = docs.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"))
    out = slim.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids, texts = T.columns_of(batch, "_key", "_text")
                for a, b in T.slices(texts):
                    rows = matches([t or "" for t in texts[a:b].to_pylist()], own)
                    keys = ids[a:b].take(pa.array([r[0] for r in rows], pa.int64()))
                    rest = [pa.array([own.ids[r[1]] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int32()) for k in range(2, 7))]
                    yield pa.RecordBatch.from_arrays([keys, *rest], names)

        out = out.unionByName(slim.mapInArrow(run, schema))
    return out.distinct().withColumnRenamed("_key", "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a piece of the benchmark; all their columns, whatever their names, and nothing is shuffled."""
    flag = fresh(docs, "_held")
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (texts,) = T.columns_of(batch, "text")
                for a, b in T.slices(texts):
                    held = {r[0] for r in matches([t or "" for t in texts[a:b].to_pylist()], shared.value, True)}
                    yield batch.slice(a, b - a).append_column(flag, pa.array([k in held for k in range(b - a)]))

        flagged = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(flag, BooleanType())]))
        docs = flagged.filter(~F.col(flag)).drop(flag)
    return docs


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
