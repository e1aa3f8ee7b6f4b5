"""Suffix-array dedup: every byte that a string of `LENGTH` bytes covers which also starts anywhere else, in any document.

Candidates come first, without loss. Every window of `LENGTH` bytes has an anchor, the lowest hash among its runs of a few bytes; neighbouring
windows with one anchor are a block. Equal windows have equal anchors, so a block whose anchor occurs once is no candidate, and equal blocks are one
kind that is looked at once, with its number. Inside what is left the same is done with longer runs.

The texts of the remaining windows are cut into phrases, at bytes where the hash of the next bytes is lowest for a while, and each phrase with the
bytes that decide its end is a symbol. The suffixes of these symbol strings are ranked by the difference-cover method (`suffix_array`). A window is
its bytes up to the next phrase and that phrase's rank: windows are sorted by both, and neighbours that agree in all their bytes are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.llm import groups as G
from buildlore.llm import texts as T
from buildlore.llm.base import query, table
from buildlore.llm.suffix_array import scratch, suffix_ranks
from buildlore.session import drop_table

LENGTH = 200
CHUNK = 1 << 22  # windows of a text that are hashed together
SLICE = 1 << 19  # bytes of pieces that are
WINDOWS = 1 << 16  # windows that are told together
SAMPLED = 64  # windows a range that its ends are chosen from
_BITS = np.uint64(24)
_LOW = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Sizes:
    """Bytes of a window, of the runs that anchors are chosen from, first and then, and of phrases' ends: a run and how many runs are compared."""

    window: int

    @property
    def run(self) -> int:
        return max(1, self.window // 5)

    @property
    def long_run(self) -> int:
        return max(1, self.window * 4 // 5)

    @property
    def end_run(self) -> int:
        return max(1, self.window // 25)

    @property
    def end_reach(self) -> int:
        return max(1, self.window // 4)

    @property
    def decides(self) -> int:
        """Bytes from a phrase's start on that decide that it is one."""
        return self.end_run + self.end_reach - 1


class Hashes:
    """Hashes of any stretch of a text."""

    def __init__(self, data: np.ndarray):
        up, self.down = T._powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return T.mix((self.total[stop] - self.total[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def runs(self, size: int) -> np.ndarray:
        return T.mix((self.total[size:] - self.total[:-size]) * self.down[: len(self.total) - size])


def lowest(h: np.ndarray, reach: int) -> np.ndarray:
    """The lowest of each `reach` neighbouring values."""
    n = len(h) - reach + 1
    if n < 1:
        return h[:0]
    x = np.r_[h, np.full(-len(h) % reach, np.uint64(0xFFFFFFFFFFFFFFFF))].reshape(-1, reach)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[reach - 1 : reach - 1 + n])


def anchored(data: np.ndarray, asked: np.ndarray, run: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """(anchor's hash, first window, window behind the last) of each block of the asked windows of a few texts that lie one after the other.

    `asked` are the windows' first bytes, rising. Of equal hashes in a window the first is the anchor. Neighbouring windows with one anchor are a block.
    """
    hashes = Hashes(data)
    h = hashes.runs(run)
    best = lowest((h >> _BITS << _BITS) | np.arange(len(h), dtype=np.uint64), window - run + 1)
    at = (best[asked] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (asked[1:] != asked[:-1] + 1)][: len(at)])
    return h[at[new]], asked[new], asked[np.r_[new[1:], len(at)][: len(new)] - 1] + 1, hashes


def parts(at: np.ndarray, sizes: Sizes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first byte, byte behind the last, windows) of texts that start `at` bytes of a slice: the slice as a whole, or a long text in parts of `CHUNK`."""
    if at[-1] <= CHUNK + sizes.window or len(at) > 2:
        room = np.maximum(np.diff(at) - sizes.window + 1, 0)
        yield 0, int(at[-1]), np.repeat(at[:-1] - np.cumsum(room) + room, room) + np.arange(room.sum())
        return
    for start in range(0, int(at[-1]) - sizes.window + 1, CHUNK):  # where a block is cut does not matter
        stop = min(int(at[-1]), start + CHUNK + sizes.window - 1)
        yield start, stop, np.arange(stop - start - sizes.window + 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows that agree in id and text have one key, and every row counts."""
    return docs.select(F.xxhash64("doc_id", "text").alias("i"), F.xxhash64(F.lit(7), "text", "doc_id").alias("j"), F.col("doc_id").alias("_key"), F.coalesce("text", F.lit("")).alias("_text"))


def _all_blocks(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """(i, j, anchor, kind, first, stop) of every block: its text, its anchor, a hash of all its bytes, and its windows."""
    names = ["i", "j", "anchor", "kind", "first", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, texts = T.columns_of(batch, "i", "j", "_text")
            for x, y in T.slices(texts):
                data, at = T.utf8(texts[x:y])
                for a, b, windows in parts(at, sizes):
                    if not len(windows):
                        continue
                    anchor, first, stop, hashes = anchored(data[a:b], windows, sizes.run, sizes.window)
                    kind = hashes.of(first, stop + sizes.window - 1)
                    own = np.searchsorted(at, first + a, "right") - 1
                    begin = at[own] - a
                    row = pa.array(own + x)
                    numbers = [pa.array(v) for v in (anchor.view(np.int64), kind.view(np.int64), first - begin, stop - begin)]
                    yield pa.RecordBatch.from_arrays([i.take(row), j.take(row), *numbers], names)

    return docs.select("i", "j", "_text").mapInArrow(run, "i bigint, j bigint, anchor bigint, kind bigint, first bigint, stop bigint")


def _pieces(told: DataFrame, sizes: Sizes) -> DataFrame:
    """(piece, i, j, start, data, asked): the stretches of a text that hold its blocks, and which of their windows are asked for, by runs."""
    names = ["piece", "i", "j", "start", "data", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i, j, text, asked in zip(*(c.to_pylist() for c in T.columns_of(batch, "i", "j", "_text", "asked"))):
                data, rows = text.encode(), []
                for part in merged(np.array([[b["first"], b["stop"]] for b in asked]), sizes.window - 1):
                    start, stop = int(part[0][0]), int(part[-1][1])
                    rows.append([number, i, j, start, data[start : stop + sizes.window - 1], (part - start).ravel()])
                    number += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return told.mapInArrow(run, "piece bigint, i bigint, j bigint, start bigint, data binary, asked array<bigint>")


def merged(runs: np.ndarray, reach: int) -> list[np.ndarray]:
    """Runs (first, stop) in order, joined where they touch or overlap, in parts whose runs lie within `reach` of each other."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    stop = np.maximum.accumulate(runs[:, 1])
    new = np.flatnonzero(np.r_[True, runs[1:, 0] > stop[:-1]])
    joined = np.stack([runs[new, 0], stop[np.r_[new[1:], len(runs)] - 1]], axis=1)
    return np.split(joined, np.flatnonzero(joined[1:, 0] - joined[:-1, 1] > reach) + 1)


def _windows(runs: np.ndarray) -> np.ndarray:
    """All windows of runs (first, stop) in order."""
    size = runs[:, 1] - runs[:, 0]
    return np.repeat(runs[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())


@dataclass(frozen=True)
class Batch:
    """Pieces that lie one after the other: their bytes, where each starts there, their rows in the record batch, and the runs of windows asked for."""

    data: np.ndarray
    at: np.ndarray
    rows: np.ndarray
    runs: np.ndarray


def _together(batch: pa.RecordBatch) -> Iterator[Batch]:
    """The pieces of a record batch in slices of about `SLICE` bytes."""
    column, asked = T.columns_of(batch, "data", "asked")
    column = column.cast(pa.large_binary())
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    flat, place = np.asarray(asked.flatten()), np.r_[0, np.cumsum(np.asarray(asked.value_lengths()).astype(np.int64))]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(edge, edge[start] + SLICE, "right")) - 1)
        at = edge[start : stop + 1] - edge[start]
        runs = flat[place[start] : place[stop]].reshape(-1, 2)
        runs = runs + np.repeat(at[:-1], np.diff(place[start : stop + 1]) // 2)[:, None]
        yield Batch(data[edge[start] : edge[stop]], at, np.arange(start, stop), runs)
        start = stop


def _long_anchors(own: Batch, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, stop) of the blocks by longer runs of the windows asked for."""
    out = []
    for low in range(0, max(1, len(own.data)), CHUNK):
        runs = np.clip(own.runs, low, low + CHUNK)
        runs = runs[runs[:, 0] < runs[:, 1]]
        if len(runs):
            anchor, first, stop, _ = anchored(own.data[low : low + CHUNK + sizes.window - 1], _windows(runs - low), sizes.long_run, sizes.window)
            out.append((anchor.view(np.int64), first + low, stop + low))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _narrowed(pieces: DataFrame, sizes: Sizes) -> DataFrame:
    """The same pieces, cut to the windows whose longer anchors occur again."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _together(batch):
                names, times = np.unique(_long_anchors(own, sizes)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(times.astype(np.int64))], ["id", "n"])

    again = pieces.select("data", "asked").mapInArrow(anchors, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).filter("n > 1").select("id")
    wanted = G.likely(again)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            i, j, begin = (c.to_numpy() for c in T.columns_of(batch, "i", "j", "start"))
            for own in _together(batch):
                anchor, first, stop = _long_anchors(own, sizes)
                keep = wanted.holds(anchor)
                first, stop = first[keep], stop[keep]
                if not len(first):
                    continue
                # joined where they touch, and pieces anew where nothing is asked for in between
                new = np.r_[True, (first[1:] > stop[:-1])]
                text = np.searchsorted(own.at, first, "right") - 1
                new[1:] |= text[1:] != text[:-1]
                head = np.flatnonzero(new)
                first, stop, text = first[head], stop[np.r_[head[1:], len(stop)] - 1], text[head]
                split = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (first[1:] - stop[:-1] >= sizes.window)])
                count = np.diff(np.r_[split, len(first)])
                low, high = first[split], stop[np.r_[split[1:], len(stop)] - 1] + sizes.window - 1
                asked = np.stack([first, stop], axis=1) - np.repeat(low, count)[:, None]
                row = own.rows[text[split]]
                at = np.r_[0, np.cumsum(2 * count)].astype(np.int32)
                columns = [number + np.arange(len(split)), i[row], j[row], begin[row] + low - own.at[text[split]]]
                number += len(split)
                held = pa.array([own.data[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), held, pa.ListArray.from_arrays(pa.array(at), pa.array(asked.ravel()))], ["piece", "i", "j", "start", "data", "asked"])

    return pieces.mapInArrow(cut, "piece bigint, i bigint, j bigint, start bigint, data binary, asked array<bigint>")


def phrases(own: Batch, hashes: Hashes, sizes: Sizes) -> np.ndarray:
    """Where phrases start: bytes whose next run has the lowest hash for a while, which the bytes of the piece from there on decide."""
    best = lowest(h := hashes.runs(sizes.end_run), sizes.end_reach) if len(own.data) >= sizes.decides else np.zeros(0, np.uint64)
    at = np.flatnonzero(h[: len(best)] == best) if len(best) else np.zeros(0, np.int64)
    return at[at + sizes.decides <= own.at[np.searchsorted(own.at, at, "right")]]


def _symbols(pieces: DataFrame, sizes: Sizes) -> DataFrame:
    """(text, at, word, ahead): the phrases of each piece, each with the bytes that decide its end, and how many more start within a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (names,) = T.columns_of(batch, "piece")
            for own in _together(batch):
                at = phrases(own, Hashes(own.data), sizes)
                text = np.searchsorted(own.at, at, "right") - 1
                first = np.searchsorted(text, np.arange(len(own.at)))
                last = np.r_[text[1:] != text[:-1], True][: len(at)]
                ends = np.where(last, own.at[text + 1], np.r_[at[1:], 0][: len(at)] + sizes.decides)
                ahead = np.minimum(np.searchsorted(at, at + sizes.window), first[text + 1]) - np.arange(len(at))
                held = own.data.tobytes()
                words = [held[a:b] for a, b in zip(at.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own.rows[text])), pa.array(np.arange(len(at)) - first[text]), pa.array(words, pa.binary()), pa.array(ahead)], ["text", "at", "word", "ahead"])

    return pieces.mapInArrow(run, "text bigint, at bigint, word binary, ahead bigint")


def _range_of(tail: np.ndarray, rank: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the ends (tail, rank), in order, are at or before each (tail, rank)."""
    tails, ranks = ends
    at, stop = np.searchsorted(tails, tail), np.searchsorted(tails, tail, "right")
    for k in np.flatnonzero(at < stop):
        at[k] += np.searchsorted(ranks[at[k] : stop[k]], rank[k], "right")
    return at


def _ends(pieces: DataFrame, ranks: DataFrame, sizes: Sizes, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The ends (tail, rank) of about equal ranges of the windows, from `SAMPLED` windows a range.

    Windows of some pieces are looked at, as making all of them twice would cost as much as sorting them.
    """
    total = pieces.select(F.aggregate("asked", F.lit(0).cast("bigint"), lambda t, v: v - t).alias("n")).agg(F.sum("n")).collect()[0][0] or 0
    share = min(64, max(1, total // (1024 * parts)))
    stride = max(1, total // (share * parts * SAMPLED))
    few = _ranked_windows(pieces.filter(F.pmod(F.xxhash64("piece"), F.lit(share)) == 0), ranks, sizes).filter(F.pmod(F.xxhash64("piece", "at"), F.lit(stride)) == 0)
    told = sorted((r.tail, r.rank) for r in few.select("tail", "rank").collect())
    if len(told) < parts:  # tails are hashes
        told = [(v, 0) for v in np.linspace(-(2.0**63), 2.0**63, parts, endpoint=False).astype(np.int64).tolist()]
    picked = [told[len(told) * k // parts] for k in range(1, parts)]
    return np.array([t for t, _ in picked], np.int64), np.array([r for _, r in picked], np.int64)


def _ranked_windows(pieces: DataFrame, ranks: DataFrame, sizes: Sizes, ends: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(tail, rank, own, piece, at) of every window: its bytes up to the next phrase, that phrase's rank, and all its bytes, by hashes; with `ends` its range."""
    listed = ranks.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("at", "rank"))).alias("ranks")).select(F.col("text").alias("piece"), F.col("ranks.rank").alias("ranks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, listed = T.columns_of(batch, "piece", "ranks")
            names = names.to_numpy()
            every, place = np.asarray(listed.flatten()).astype(np.int64), np.r_[0, np.cumsum(np.asarray(listed.value_lengths().fill_null(0)).astype(np.int64))]
            for own in _together(batch):
                hashes = Hashes(own.data)
                at = phrases(own, hashes, sizes)
                ranks = np.r_[every[place[own.rows[0]] : place[own.rows[-1] + 1]], 0]  # a rank for each phrase, in order
                windows = _windows(own.runs)
                for x in range(0, len(windows), WINDOWS):
                    s = windows[x : x + WINDOWS]
                    key = hashes.of(s, s + sizes.window)
                    k = np.searchsorted(at, s)
                    stop = np.r_[at, len(own.data)][k] + sizes.decides
                    has = (k < len(at)) & (stop <= s + sizes.window)  # a window without a phrase is its own name
                    tail, rank = key.copy(), np.zeros(len(s), np.int64)
                    tail[has], rank[has] = hashes.of(s[has], stop[has]), ranks[k[has]]
                    text = np.searchsorted(own.at, s, "right") - 1
                    made = [tail.view(np.int64), rank, key.view(np.int64), names[own.rows[text]], s - own.at[text]]
                    if ends is not None:
                        made.append(_range_of(made[0], rank, ends).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in made], columns[: len(made)])

    columns = ["tail", "rank", "own", "piece", "at", "range"]
    schema = "tail bigint, rank bigint, own bigint, piece bigint, at bigint" + (", range int" if ends is not None else "")
    return pieces.select("piece", "data", "asked").join(listed, "piece", "left").mapInArrow(run, schema)


def _repeated_windows(windows: DataFrame, parts: int, made: list[str]) -> DataFrame:
    """(piece, at) of the windows, dealt over `parts` ranges, whose neighbour in order is equal."""
    names = ["range", "edge", "tail", "own", "piece", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kept = None

        def rows(edge, columns, mask):
            own = [pa.array(c[mask]) for c in columns]
            n = len(own[0])
            own[:2] = own[:2] if edge else [pa.nulls(n, pa.int64())] * 2  # only ends are compared again
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, edge), pa.int32()), *own], names)

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("tail", "own", "piece", "at")]
            if first:
                yield rows(1, columns, slice(0, 1))
                first = False
            joined = False
            if kept is not None:
                joined = kept[1]
                columns = [np.r_[k, c] for k, c in zip(kept[0], columns)]
            same = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])
            hit = np.r_[same, False] | np.r_[joined, same]
            yield rows(0, columns, np.flatnonzero(hit[:-1]))
            kept = [c[-1:] for c in columns], bool(hit[-1])
        if kept is not None:
            if kept[1]:
                yield rows(0, kept[0], slice(0, 1))
            yield rows(2, kept[0], slice(0, 1))

    ordered = windows.repartitionById(parts, "range").drop("range").sortWithinPartitions("tail", "rank", "own")
    told = scratch(ordered.mapInArrow(run, "range int, edge int, tail bigint, own bigint, piece bigint, at bigint"), made)
    # windows of one tail may lie on both sides of where two ranges meet: two rows a range tell
    ends = sorted(told.filter("edge > 0").collect(), key=lambda r: (r.range, r.edge))
    more = [(r.piece, r.at) for a, b in zip(ends[1::2], ends[2::2]) if (a.tail, a.own) == (b.tail, b.own) for r in (a, b)]
    spark = windows.sparkSession
    return told.filter("edge = 0").select("piece", "at").unionByName(spark.createDataFrame(more, "piece bigint, at bigint"))


def _runs(hits: DataFrame) -> DataFrame:
    """(piece, first, stop) runs of neighbouring windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, at = (c.to_numpy() for c in batch.columns)
            new = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (at[1:] > at[:-1] + 1)][: len(at)])
            last = np.r_[new[1:] - 1, len(at) - 1][: len(new)]
            yield pa.RecordBatch.from_arrays([pa.array(piece[new]), pa.array(at[new]), pa.array(at[last] + 1)], ["piece", "first", "stop"])

    return hits.repartition("piece").sortWithinPartitions("piece", "at").mapInArrow(run, "piece bigint, first bigint, stop bigint")


def _spans(docs: DataFrame, sizes: Sizes, made: list[str]) -> DataFrame:
    """(i, j, runs): of every text with repeated windows, the runs (first, stop) of them, in no order and perhaps overlapping."""
    spark, used, cut = docs.sparkSession, [], []

    def drop(tables: list[str]) -> None:
        for place in tables:
            drop_table(spark, place)
        tables.clear()

    every = scratch(_all_blocks(docs, sizes), used)
    kinds = every.groupBy("anchor", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = scratch(kinds, used)
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("anchor", F.lit(True).alias("several"))
    told = kinds.join(several, "anchor", "left").filter("several or n > 1")
    told = scratch(told.select("anchor", "kind", F.col("kind").alias("id"), "n", F.coalesce("several", F.lit(False)).alias("several")), used)
    near = G.likely_members(every.withColumn("id", F.col("kind")), told.select("id").distinct()).drop("id")
    marked = scratch(near.join(told.drop("id"), ["anchor", "kind"]), made)
    drop(used)
    whole = marked.filter("n > 1").select("i", "j", "first", "stop")
    offered = marked.filter("several").groupBy("anchor", "kind").agg(F.min(F.struct("i", "j", "first", "stop")).alias("b")).select("b.*")
    asked = offered.groupBy("i", "j").agg(F.collect_list(F.struct("first", "stop")).alias("asked")).withColumn("id", F.col("i"))
    asked = scratch(asked, used)
    texts = G.likely_members(docs.select("i", "j", "_text").withColumn("id", F.col("i")), asked.select("id").distinct()).drop("id")
    pieces = scratch(_narrowed(scratch(_pieces(texts.join(asked.drop("id"), ["i", "j"]), sizes), used), sizes), made)
    drop(used)
    symbols = scratch(_symbols(pieces, sizes), cut)
    depth = symbols.agg(F.max("ahead")).collect()[0][0]
    found = whole
    if depth is not None or not pieces.isEmpty():
        ranks = suffix_ranks(symbols.drop("ahead"), (depth or 0) + 1, made)
        drop(cut)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hits = _repeated_windows(_ranked_windows(pieces, ranks, sizes, _ends(pieces, ranks, sizes, parts)), parts, made)
        own = pieces.select("piece", "i", "j", "start")
        runs = _runs(hits).join(own, "piece").select("i", "j", (F.col("first") + F.col("start")).alias("first"), (F.col("stop") + F.col("start")).alias("stop"))
        found = found.unionByName(runs)
    return found.groupBy("i", "j").agg(F.collect_list(F.struct("first", "stop")).alias("runs"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row of `docs` (doc_id, text): the stretches of bytes that go, in order, and the bytes that stay.

    A byte goes if a string of `length` bytes covers it that also starts at another place, of the same text or another; strings do not cross texts.
    A null text is empty. Rows that agree in id and text count as texts of their own. Bytes that stay may cut a character in two. Other columns
    are not looked at.
    """
    sizes, made = Sizes(length), []
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            keys, texts, runs = T.columns_of(batch, "_key", "_text", "runs")
            for x, y in T.slices(texts):
                out = [[], [], []]
                for text, own in zip(texts[x:y].to_pylist(), runs[x:y].to_pylist()):
                    data, gone = text.encode(), []
                    if own:
                        for part in merged(np.array([[r["first"], r["stop"] + sizes.window - 1] for r in own]), 0):
                            gone += [{"start": a, "stop": b} for a, b in part.tolist()]
                    edges = [0, *(v for g in gone for v in (g["start"], g["stop"])), len(data)]
                    for column, value in zip(out, (len(data), gone, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([keys[x:y], pa.array(out[0], pa.int64()), pa.array(out[1], spans), pa.array(out[2], pa.binary())], names)

    try:
        keyed = _keyed(docs)
        spans = scratch(_spans(keyed, sizes, made), kept := [])
        schema = f"doc_id {kind}, n_bytes bigint, removed array<struct<start: bigint, stop: bigint>>, kept binary"
        return keyed.join(spans, ["i", "j"], "left").select("_key", "_text", "runs").mapInArrow(run, schema)
    finally:
        for place in made:
            drop_table(spark, place)


@query("op12_suffix_dedup")
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, r: total + r["stop"] - r["start"])
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
