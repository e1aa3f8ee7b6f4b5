"""Cross-tokenizer alignment: where two tokenizers' tokens end at the same byte, and which of their tokens overlap.

Every text is encoded by both tokenizers, and each token's last byte gives a rising list of ends. The shorter list drives a galloping search into
the longer: from a guess, steps double until the value is bracketed, and a binary search ends inside the bracket. Common ends slice both lists into
groups; the rank of a token's end less that of its start gives the range of the other side's tokens that overlap it.

How many documents hold a linked pair of ids is counted over the whole corpus. Texts are cut into parts of bounded size, which send each of
their distinct pairs once with its number of documents; the totals come back to the parts that asked. No task holds all pairs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.llm.base import query, table
from buildlore.llm.byte_bpe import byte_characters
from buildlore.llm.texts import columns_of, slices
from buildlore.session import drop_table, write_table

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
PART_LINKS = 4_000_000  # links of texts that ask for the totals together; a longer text is a part of its own
ROW_PAIRS = 1 << 15  # pairs of a part that a row holds
CODEC = "zstd"


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For every value of `short` how many values of `long` are smaller; both rise.

    All searches go on together: each starts where it would be if both lists were spread alike, doubles its step until it has passed its
    value, and halves the bracket it has then.
    """
    n, m = len(short), len(long)
    if not n or not m:
        return np.zeros(n, np.int64)
    start = np.minimum(np.arange(n) * m // n, m - 1)
    up = long[start] < short
    low, high = np.where(up, start, -1), np.where(up, m, start)  # long[low] < value <= long[high], with guards at both ends
    live, step = np.arange(n), 1
    while len(live):
        at = np.where(up[live], start[live] + step, start[live] - step)
        inside = (at > -1) & (at < m)
        live, at = live[inside], at[inside]
        less = long[at] < short[live]
        low[live[less]] = np.maximum(low[live[less]], at[less])
        high[live[~less]] = np.minimum(high[live[~less]], at[~less])
        live = live[less == up[live]]
        step *= 2
    live = np.flatnonzero(high - low > 1)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        less = long[mid] < short[live]
        low[live[less]] = mid[less]
        high[live[~less]] = mid[~less]
        live = live[high[live] - low[live] > 1]
    return low + 1


@dataclass(frozen=True)
class Alignment:
    """Of two tokenisations of the same bytes: where each group stops on either side, and for each token of the driving side the overlapping ones."""

    stops_a: np.ndarray  # index behind each group's last token
    stops_b: np.ndarray
    swapped: bool  # the driving side is B
    first: np.ndarray  # of each driving token the first overlapping token of the other side
    links: np.ndarray  # and how many there are

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(index of A, index of B) of every overlapping pair of tokens."""
        own = np.repeat(np.arange(len(self.links)), self.links)
        other = np.arange(len(own)) - np.repeat(np.cumsum(self.links) - self.links - self.first, self.links)
        return (other, own) if self.swapped else (own, other)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Both lists rise strictly and have the same last value."""
    swapped = len(ends_b) < len(ends_a)
    own, other = (ends_b, ends_a) if swapped else (ends_a, ends_b)
    rank = gallop(own, other)
    common = other[np.minimum(rank, len(other) - 1)] == own if len(other) else np.zeros(0, bool)
    stops = np.flatnonzero(common) + 1, rank[common] + 1
    first = np.zeros(len(own), np.int64)
    first[1:] = (rank + common)[:-1]  # the tokens of the other side that end no later than this one starts
    return Alignment(*(stops[::-1] if swapped else stops), swapped, first, rank - first + 1)


class Tokens:
    """A tokenizer's ids of texts, and the bytes of each id."""

    def __init__(self, spelled: list[bytes], encode):
        self.spelled, self.encode = spelled, encode
        self.sizes = np.array([len(s) for s in spelled], np.int64)

    def ends(self, ids: np.ndarray, whole: bytes) -> np.ndarray | None:
        """Where each token ends in `whole`; None if the tokens do not spell it."""
        if b"".join([self.spelled[i] for i in ids.tolist()]) != whole:
            return None
        return np.cumsum(self.sizes[ids])


def byte_level(path: str) -> Tokens:
    """A byte-level BPE tokenizer file. Its merges are its ids in order, so the rank library encodes as the file's own library does, and faster."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)["model"]
    back = {c: b for b, c in enumerate(byte_characters())}
    ranks = {bytes(back[c] for c in piece): i for piece, i in told["vocab"].items()}
    merged = [ranks[bytes(back[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in told["merges"]]
    if merged != sorted(merged) or sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"the ids in {path} are not in the order of its merges")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokens(sorted(ranks, key=ranks.get), lambda texts: [np.array(encoding.encode_ordinary(" " + t), np.int64) for t in texts])


def pieces(path: str) -> Tokens:
    """A sentencepiece model with byte fallback, which puts a space before a text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelled.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokens(spelled, lambda texts: [np.array(ids, np.int64) for ids in model.encode(texts, num_threads=1)])


def _digits(size: int) -> np.ndarray:
    """(size, width) decimal digits of each number, zero where there is none to the left."""
    width = len(str(max(1, size - 1)))
    out = np.zeros((size, width), np.uint8)
    for i in range(size):
        text = str(i).encode()
        out[i, width - len(text) :] = list(text)
    return out


def spelled_groups(a: np.ndarray, b: np.ndarray, found: Alignment, digits: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group."""
    size_a, size_b = np.diff(found.stops_a, prepend=0), np.diff(found.stops_b, prepend=0)
    ids, marks = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[np.arange(len(a)) + np.repeat(found.stops_b - size_b, size_a)] = a
    ids[np.arange(len(b)) + np.repeat(found.stops_a, size_b)] = b
    marks[found.stops_a + found.stops_b - size_b - 1] = ord("|")
    marks[found.stops_a + found.stops_b - 1] = ord(";")
    out = np.empty((len(ids), digits.shape[1] + 1), np.uint8)
    out[:, :-1] = digits[ids]
    out[:, -1] = marks
    out = out.ravel()
    return out[out > 0][:-1].tobytes()


class Aligner:
    """Both tokenizers of a worker."""

    _made: dict = {}

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_level(path_a), pieces(path_b)
        self.digits = _digits(max(len(self.a.spelled), len(self.b.spelled)))

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._made:
            cls._made[path_a, path_b] = cls(path_a, path_b)
        return cls._made[path_a, path_b]

    def run(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, Alignment] | None]:
        """Ids of A, ids of B and their alignment; None for an empty text and for one that either tokenizer does not spell back."""
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            whole = b" " + text.encode()
            ends_a = self.a.ends(a, whole) if text else None
            ends_b = None if ends_a is None else self.b.ends(b, whole)
            yield None if ends_b is None else (a, b, align(ends_a, ends_b))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_stops, b_stops) of every row of `docs` (doc_id, text): both sides' ids, and where each group stops among them.

    Null and empty texts, and texts that a tokenizer changes, have empty lists. Repeated rows and null ids stay as they are; other columns are
    not looked at.
    """
    names = ["doc_id", "a_ids", "b_ids", "a_stops", "b_stops"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner.of(path_a, path_b)
        for batch in batches:
            ids, texts = columns_of(batch, "_key", "_text")
            for x, y in slices(texts):
                told = [[], [], [], []]
                for found in own.run([t or "" for t in texts[x:y].to_pylist()]):
                    row = (found[0], found[1], found[2].stops_a, found[2].stops_b) if found else ([],) * 4
                    for column, value in zip(told, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([ids[x:y], *(pa.array(c, pa.list_(pa.int32())) for c in told)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"))
    return slim.mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>")


def _pack(values: np.ndarray) -> bytes:
    """Numbers in few bytes: bytes of the same place together, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec=CODEC, asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec=CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<i8").ravel()


class _Part:
    """The distinct pairs of the texts of a part, with their numbers of documents."""

    def __init__(self):
        self.links, self.parts, self.counts = 0, [], []

    def add(self, pairs: np.ndarray, links: int) -> None:
        self.links += links
        self.parts.append(pairs)
        self.counts.append(np.ones(len(pairs), np.int64))
        if len(self.parts) == 512:
            self.squeeze()

    def squeeze(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, own = np.unique(np.concatenate(self.parts), return_inverse=True)
        counts = np.bincount(own, np.concatenate(self.counts), len(pairs)).astype(np.int64)
        self.parts, self.counts = [pairs], [counts]
        return pairs, counts


_FIGURES = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def _linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds: a text's figures and its packed pairs, and (after a part's texts) the part's distinct pairs with their documents."""
    names = ["part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "packed", "times", "pairs", "documents"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part bigint, doc_id {kind}, {_FIGURES}, held int, packed binary, times binary, pairs array<bigint>, documents array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Aligner.of(path_a, path_b)
        task, number, part = TaskContext.get().partitionId(), 0, _Part()
        key_type = pa.null()

        def row(keys, values):
            kinds = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [keys] + [pa.array([v[k] for v in values], t) for k, t in enumerate(kinds[1:])]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number] * len(values), pa.int64()), *columns], names)

        def told():
            pairs, counts = part.squeeze()
            for x in range(0, len(pairs), ROW_PAIRS):
                yield row(pa.nulls(1, key_type), [[None] * 8 + [pairs[x : x + ROW_PAIRS], counts[x : x + ROW_PAIRS]]])

        for batch in batches:
            ids, texts = columns_of(batch, "_key", "_text")
            key_type = ids.type
            for x, y in slices(texts):
                values = []
                for found in own.run([t or "" for t in texts[x:y].to_pylist()]):
                    if found is None:
                        values.append([0, 0, 0, 0, "", 0, None, None, None, None])
                        continue
                    a, b, groups = found
                    left, right = groups.pairs()
                    pairs, times = np.unique((a[left] << 32) + b[right], return_counts=True)
                    part.add(pairs, len(left))
                    digest = hashlib.sha256(spelled_groups(a, b, groups, own.digits)).hexdigest()
                    values.append([len(a), len(b), len(groups.stops_a), len(left), digest, len(pairs), _pack(np.diff(pairs, prepend=0)), _pack(times), None, None])
                yield row(ids[x:y], values)
                if part.links >= PART_LINKS:
                    yield from told()
                    number, part = number + 1, _Part()
        yield from told()

    slim = docs.select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"))
    return slim.mapInArrow(run, schema)


def link_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a_id, b_id, documents) of every pair of ids that overlap somewhere: the number of rows of `docs` that hold it linked."""
    told = _linked(docs, path_a, path_b).filter("pairs is not null")
    return _totals(told).select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b_id"), "documents")


def _totals(told: DataFrame) -> DataFrame:
    each = told.select(F.explode(F.arrays_zip("pairs", "documents")).alias("p")).select("p.pairs", "p.documents")
    return each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("documents"))


def alignment_digest(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each of `docs` (doc_id, text): its numbers of tokens, groups and links, a digest of its groups, and how common its links are.

    `n_best` links have a pair that more documents hold than any other pair of the same A id (ties included), `count_sum` adds the pairs' numbers of
    documents over all links. Null and empty texts, and those whose tokens do not spell a space and the text, have zeros and an empty digest.
    Repeated rows count as documents of their own. The result reads two tables in the shared folder.
    """
    whole, place = write_table(_linked(docs, path_a, path_b))
    try:
        asked = whole.filter("pairs is not null")
        totals = _totals(asked)
        most = totals.groupBy(F.shiftright("pair", 32).alias("a_id")).agg(F.max("documents").alias("most"))
        known = totals.withColumn("a_id", F.shiftright("pair", 32)).join(most, "a_id").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))
        answers = asked.select(F.col("part").alias("asker"), F.explode("pairs").alias("pair")).join(known, "pair")
        rows = whole.filter("n_a is not null").drop("pairs", "documents")
        kind = docs.schema["doc_id"].dataType.simpleString()
        out, _ = write_table(rows.groupBy("part").cogroup(answers.groupBy("asker")).applyInArrow(_summed, f"doc_id {kind}, {_FIGURES}, n_best bigint, count_sum bigint"))
    finally:
        drop_table(docs.sparkSession, place)
    return out


def _summed(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The figures of a part's texts, with the totals of its pairs looked up."""
    pair, documents, best = (answers[c].to_numpy() for c in ("pair", "documents", "best"))
    order = np.argsort(pair)
    pair, documents, best = pair[order], documents[order], best[order]
    n_best, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k, (held, packed, times) in enumerate(zip(rows["held"].to_pylist(), rows["packed"].to_pylist(), rows["times"].to_pylist())):
        if held:
            at, times = np.searchsorted(pair, np.cumsum(_unpack(packed, held))), _unpack(times, held)
            n_best[k], total[k] = times[best[at]].sum(), (times * documents[at]).sum()
    kept = rows.select(["doc_id", *(c.split()[0] for c in _FIGURES.split(", "))])
    return kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(FIRST), public_tokenizers.path(SECOND))
