"""Substring dedup: passages that occur in several documents, or twice in one, and lines that are near copies of others.

A passage is a run of `LEAST_WORDS` words or more, wherever it stands, over line ends too; runs are equal by their words. Every run of `LEAST_WORDS` words has an
anchor, the lowest hash among its runs of `ANCHOR_WORDS` words, which its words alone decide. Neighbouring runs with one anchor are a block.
Anchors are counted first; only blocks of anchors that occur again move, and where the blocks of an anchor differ, the runs of the first one of
each kind move one by one. So no equal run is missed, and a copied text moves a row a block.

A paragraph is a line of text. Distinct lines are banded by MinHash of five-word shingles, with as many bands as a high recall at the threshold
takes; lines that collide are compared by exact Jaccard similarity, linked lines form components, and of each component only the first
occurrence stays. Only documents with a candidate line are read again and move their lines; everything else that moves is a few numbers a line.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from buildlore.llm import groups as G
from buildlore.llm import texts as T
from buildlore.llm.base import fresh, query, table
from buildlore.session import drop_table, write_table

WORDS = 5
SIMILARITY = Fraction(4, 5)
RECALL = 0.996  # of a pair at the threshold; at 0.85 it is above 0.999
ROWS = 3
LEAST_WORDS = 20  # shorter passages are phrases that documents may share
ANCHOR_WORDS = 10  # of the runs that anchors are chosen from, LEAST_WORDS - ANCHOR_WORDS + 1 in each passage of LEAST_WORDS
SPAN_ROWS = 1 << 15  # parts of passages that are put together at a time
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bands_for(recall: float, rows: int = ROWS, similarity: float = float(SIMILARITY)) -> int:
    """The fewest bands of this many rows with which a pair at the threshold collides with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_for(RECALL)


class Cut:
    """The words of a slice of texts, and its lines of at least `LEAST_WORDS` words: each one's text number, its words from first to last, and two hashes."""

    def __init__(self, texts: pa.Array):
        data, at = T.utf8(texts)
        self.data, self.at = _LOWER[data], at
        self.h, self.doc, self.starts, self.ends = T.words(self.data, at)
        self.n_texts = len(at) - 1
        n = len(self.h)
        if not n:
            self.line = self.text = self.first = self.stop = np.zeros(0, np.int64)
            self.a, self.b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        line = np.cumsum(self.data == 10)[self.starts]
        new_line = np.r_[True, (self.doc[1:] != self.doc[:-1]) | (line[1:] != line[:-1])]
        self.line = np.cumsum(new_line) - 1
        first = np.flatnonzero(new_line)
        stop = np.r_[first[1:], n]
        long = stop - first >= LEAST_WORDS
        self.first, self.stop = first[long], stop[long]
        self.text = self.doc[self.first]
        self.a, self.b = (self.hashes(self.first, self.stop, k) for k in (1, 2))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of the blocks' first and last runs of `LEAST_WORDS` words, and the blocks' anchors.

        All runs with equal words have equal anchors at the same place in them, in whatever blocks they are.
        """
        near = LEAST_WORDS - ANCHOR_WORDS + 1
        n = len(self.h) - LEAST_WORDS + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(n + near - 1)
        grams = self.hashes(at, at + ANCHOR_WORDS, 3).view(np.uint64)
        low, place = grams[:n].copy(), np.arange(n)
        for k in range(1, near):
            less = grams[k : k + n] < low
            low[less] = grams[k : k + n][less]
            place[less] = np.flatnonzero(less) + k
        whole = self.doc[:n] == self.doc[LEAST_WORDS - 1 :]
        where = np.flatnonzero(whole)
        if not len(where):
            return where, where, where
        new = np.r_[True, (np.diff(place[where]) != 0) | (np.diff(where) != 1)]
        begin = np.flatnonzero(new)
        return where[begin], where[np.r_[begin[1:], len(where)] - 1], low[where[begin]].view(np.int64)

    def hashes(self, first: np.ndarray, stop: np.ndarray, k: int) -> np.ndarray:
        """One of several hashes of the words from first to last."""
        up, down = T._powers(len(self.h))
        return self._key(T.mix(self.h + np.uint64(k)), up, down, first, stop)

    @staticmethod
    def _key(h: np.ndarray, up: np.ndarray, down: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(h * up)]
        return T.mix((total[stop] - total[first]) * down[first] + (stop - first).astype(np.uint64)).view(np.int64)

    def places(self, first: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """The first and last word of each run in its text, and its first and last character there, the last ones excluded."""
        if not len(first):
            return [np.zeros(0, np.int32)] * 4
        text = self.doc[first]
        word = self.in_text(first)
        chars = np.r_[0, np.cumsum((self.data & 0xC0) != 0x80)]
        begin = chars[self.at[text]]
        return [x.astype(np.int32) for x in (word, word + stop - first, chars[self.starts[first]] - begin, chars[self.ends[stop - 1]] - begin)]

    def in_text(self, word: np.ndarray) -> np.ndarray:
        """The words' numbers in their texts."""
        return word - np.searchsorted(self.doc, np.arange(self.n_texts))[self.doc[word]] if len(word) else word

    def line_shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of the lines, with their place among these."""
        if not len(self.first):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        place = np.full(int(self.line[-1]) + 1, -1)
        place[self.line[self.first]] = np.arange(len(self.first))
        own = place[self.line]
        return T.shingles(self.h[own >= 0], own[own >= 0], WORDS)


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Cut]]:
    for batch in batches:
        ids, texts = T.columns_of(batch, "id", "_text")
        for a, b in T.slices(texts):
            yield ids[a:b], Cut(texts[a:b])


_PLACES = "word int, word_stop int, start int, end int"
_PLACE_NAMES = ["word", "word_stop", "start", "end"]


def units(docs: DataFrame) -> DataFrame:
    """Rows of two kinds, from one reading of the texts.

    Lines of at least `LEAST_WORDS` words: their text `id`, places, hashes a and b, and bands. Anchors of blocks (with `n`): the anchor as `id`, and how
    many blocks of a slice of texts have it.
    """
    names = ["id", *_PLACE_NAMES, "a", "b", "bands", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, cut in _cuts(batches):
            n = len(cut.first)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(_bands(cut).view(np.int64).ravel()))
            lines = [ids.take(pa.array(cut.text)), *map(pa.array, cut.places(cut.first, cut.stop)), pa.array(cut.a), pa.array(cut.b), flat, pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(lines, names)
            anchors, times = np.unique(cut.runs()[2], return_counts=True)
            none = [pa.nulls(len(anchors), kind) for kind in (*(pa.int32(),) * 4, pa.int64(), pa.int64(), flat.type)]
            yield pa.RecordBatch.from_arrays([pa.array(anchors), *none, pa.array(times.astype(np.int64))], names)

    return docs.mapInArrow(run, f"id bigint, {_PLACES}, a bigint, b bigint, bands array<bigint>, n bigint")


def _bands(cut: Cut) -> np.ndarray:
    """(lines, bands) hashes of the lines' bands of MinHash values."""
    n = len(cut.first)
    sig = T.minhash(*cut.line_shingles(), n, BANDS * ROWS).astype(np.uint64).reshape(n, BANDS, ROWS)
    band = np.zeros((n, BANDS), np.uint64)
    for k in range(ROWS):
        band = T.mix(band * np.uint64(3) + sig[:, :, k] + np.uint64(k))
    return band + np.arange(BANDS, dtype=np.uint64)


def _marks(ids: np.ndarray, word: np.ndarray) -> np.ndarray:
    return T.mix(T.mix(ids.view(np.uint64)) + word.astype(np.uint64)).view(np.int64)


def marks(blocks: DataFrame) -> DataFrame:
    """(id): a hash of the text and word where each of `blocks` (id, word) begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, word = (c.to_numpy() for c in T.columns_of(batch, "id", "word"))
            yield pa.RecordBatch.from_arrays([pa.array(_marks(ids, word))], ["id"])

    return blocks.mapInArrow(run, "id bigint")


def blocks(docs: DataFrame, wanted: G.Likely) -> DataFrame:
    """(id, word, word_stop, start, end, a, b) of the blocks whose anchors `a` are wanted, and few others."""
    return _blocks(docs, lambda ids, cut, first, anchor: wanted.holds(anchor), False)


def single_runs(docs: DataFrame, wanted: G.Likely) -> DataFrame:
    """(id, word, word_stop, start, end, a, b) of the runs of `LEAST_WORDS` words of the blocks whose marks are wanted, and few others."""
    return _blocks(docs, lambda ids, cut, first, anchor: wanted.holds(_marks(ids.take(pa.array(cut.doc[first])).to_numpy(), cut.in_text(first))), True)


def _blocks(docs: DataFrame, keeps, single: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, cut in _cuts(batches):
            first, last, anchor = cut.runs()
            keep = keeps(ids, cut, first, anchor)
            first, last, anchor = first[keep], last[keep], anchor[keep]
            if single and len(first):
                size = last - first + 1
                first = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                last, anchor = first, np.repeat(anchor, size)
            stop = last + LEAST_WORDS
            b = cut.hashes(first, stop, 1) if len(first) else anchor
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cut.doc[first])), *map(pa.array, [*cut.places(first, stop), anchor, b])], ["id", *_PLACE_NAMES, "a", "b"])

    return docs.mapInArrow(run, f"id bigint, {_PLACES}, a bigint, b bigint")


def line_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of every line of at least `LEAST_WORDS` words of the texts with one of the distinct `ids`, and of few others: its first hash, and itself."""
    docs, keep = G.likely_batches(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cut in _cuts(keep(batches)):
            first, last = (cut.starts[cut.first], cut.ends[cut.stop - 1]) if len(cut.first) else (cut.first, cut.first)
            lines = [cut.data[x:y].tobytes().decode() for x, y in zip(first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(cut.a), pa.array(lines, pa.string())], ["id", "text"])

    return docs.mapInArrow(run, "id bigint, text string")


def line_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of lines whose ASCII letters are small, as `line_texts` gives them."""
    out = []
    for a, b in T.slices(texts):
        h, doc, _, _ = T.words(*T.utf8(texts[a:b]))
        out += T.sets(*T.shingles(h, doc, WORDS), b - a)
    return out


def _first(units: DataFrame) -> DataFrame:
    """(a, b, n, first): how many units (id, places, a, b) have these hashes, and the id, word and start of the first."""
    return units.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "word", "start")).alias("first"))


def _later(units: DataFrame, keepers: DataFrame) -> DataFrame:
    """(id, places, kept) of the units that are not at the place `kept` that `keepers` (a, b, kept) has for their hashes."""
    return units.join(keepers, ["a", "b"]).filter(F.struct("id", "word", "start") != F.col("kept")).select("id", *_PLACE_NAMES, "kept")


def passages(slim: DataFrame, anchors: DataFrame, made: list[str]) -> DataFrame:
    """(id, places, kept) of parts of `slim` (id, _text) that together are all runs of `LEAST_WORDS` words which stand at an earlier place too."""
    again = G.scratch(anchors.groupBy("id").agg(F.sum("n").alias("n")).filter("n > 1").select("id"), made)
    parts = G.scratch(blocks(slim, G.likely(again)), made)
    firsts = G.scratch(_first(parts), made)
    # a block that is not the first of its kind goes as a whole; an anchor whose blocks are all equal needs no closer look
    mixed = firsts.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("a")
    first = G.scratch(marks(firsts.join(mixed, "a", "left_semi").select("first.id", "first.word")), made)
    single = G.scratch(single_runs(slim, G.likely(first)), made)
    keepers = lambda told: told.filter("n > 1").select("a", "b", F.col("first").alias("kept"))
    return _later(parts, keepers(firsts)).unionByName(_later(single, keepers(_first(single))))


def fewest(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[int]:
    """The fewest of these ranges that hold together what all of them hold, text by text; of two that reach as far the earlier one is taken."""
    out: list[int] = []
    now, covered, best, reach = -1, 0, -1, 0
    order = np.lexsort((-stop, start, text))
    for k, t, a, b in zip(order.tolist(), text[order].tolist(), start[order].tolist(), stop[order].tolist()):
        if (t != now or a > covered) and reach > covered:
            out.append(best)
            covered = reach
        if t != now or a > covered:
            now, covered, reach = t, a, a
        if b > max(reach, covered):
            best, reach = k, b
    if reach > covered:
        out.append(best)
    return out


def _spans(rows: DataFrame) -> DataFrame:
    """(id, start, end, kept_id, kept_start) from `rows` (id, places, kept, line): lines as they are, and passages put together from parts.

    Parts that overlap or touch, and whose kept ones lie in one text at the same distance, are one passage. Passages of which removed lines
    hold every word are left out, and of the others the fewest stay that hold all their words together.
    """
    names = [*_PLACE_NAMES, "kept_id", "kept_word", "kept_start", "line"]
    fields = F.struct(*_PLACE_NAMES, F.col("kept.id").alias("kept_id"), F.col("kept.word").alias("kept_word"), F.col("kept.start").alias("kept_start"), "line")
    lists = rows.groupBy("id").agg(F.collect_list(fields).alias("_rows"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
        """Texts with about `SPAN_ROWS` rows together, one text at least."""
        for batch in batches:
            ids, column = T.columns_of(batch, "id", "_rows")
            size, a = np.cumsum(np.asarray(column.value_lengths()).astype(np.int64)), 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + SPAN_ROWS, "right")))
                yield ids[a:b], column[a:b]
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, column in slices(batches):
            flat = column.flatten()
            doc = np.repeat(np.arange(len(ids)), np.asarray(column.value_lengths()))
            v = {k: np.asarray(flat.field(i)).astype(np.int64) for i, k in enumerate(names)}
            is_line = v["line"] == 1
            lines = np.flatnonzero(is_line)
            lines = lines[np.unique((doc[lines] << 32) + v["word"][lines], return_index=True)[1]]
            # words of each text that go with lines, counted up
            size = np.zeros(len(ids) + 1, np.int64)
            np.maximum.at(size, doc + 1, v["word_stop"] + 1)
            at = np.cumsum(size)[:-1][doc] if len(doc) else doc
            edge = np.zeros(int(size.sum()) + 1, np.int64)
            np.add.at(edge, (at + v["word"])[lines], 1)
            np.add.at(edge, (at + v["word_stop"])[lines], -1)
            gone = np.r_[0, np.cumsum(np.cumsum(edge) > 0)]
            part = np.flatnonzero(~is_line)
            part = part[np.lexsort((v["word"][part], (v["kept_word"] - v["word"])[part], v["kept_id"][part], doc[part]))]
            p = {k: x[part] for k, x in v.items()}
            own, off = doc[part], p["kept_word"] - p["word"]
            if len(part):
                group = np.r_[True, (np.diff(own) != 0) | (np.diff(p["kept_id"]) != 0) | (np.diff(off) != 0)]
                # the furthest end so far in each group
                number = np.cumsum(group) - 1
                reach = np.maximum.accumulate(p["word_stop"] + number * (1 << 32)) - number * (1 << 32)
                new = group | np.r_[True, p["word"][1:] > reach[:-1]]
                first = np.flatnonzero(new)
                stop, end = np.maximum.reduceat(p["word_stop"], first), np.maximum.reduceat(p["end"], first)
                x = at[part][first]
                left = gone[x + stop] - gone[x + p["word"][first]] < stop - p["word"][first]
                first, stop, end = first[left], stop[left], end[left]
                few = fewest(own[first], p["word"][first], stop)
                first, end = first[few], end[few]
            else:
                first, end = part, part
            out = [np.r_[doc[lines], own[first]], *(np.r_[v[k][lines], e] for k, e in (("start", p["start"][first]), ("end", end), ("kept_id", p["kept_id"][first]), ("kept_start", p["kept_start"][first])))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(out[0])), *(pa.array(x, kind) for x, kind in zip(out[1:], kinds))], ["id", "start", "end", "kept_id", "kept_start"])

    return lists.mapInArrow(run, "id bigint, start int, end int, kept_id bigint, kept_start int")


def _numbered(docs: DataFrame, key: str, text: str, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, _text) of the rows with a key, and (id, of, mark) of the ids that stand for a further text of a key; those come behind all keys."""
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("_text"), F.xxhash64(text).alias("mark"))
    several = rows.groupBy("id").agg(F.min("mark").alias("first"), F.max("mark").alias("last"), F.max("id").alias("top")).filter("first <> last").select("id", "first")
    more = G.scratch(rows.select("id", "mark").join(several, "id").filter("mark <> first").select("id", "mark").distinct(), made)
    if more.isEmpty():
        return rows.drop("mark"), more.select("id", F.col("id").alias("of"), "mark")
    top = rows.agg(F.max("id")).collect()[0][0]
    more = more.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark")
    more = G.scratch(more.select((F.monotonically_increasing_id() + (top + 1)).alias("id"), F.col("id").alias("of"), "mark"), made)
    stands = more.select(F.col("of").alias("id"), "mark", F.col("id").alias("own"))
    return rows.join(stands, ["id", "mark"], "left").select(F.coalesce("own", "id").alias("id"), "_text"), more


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", marks: bool = False) -> DataFrame:
    """(key, start, end, kept_id, kept_start): every passage and line to be removed, and where an earlier one stands; with `marks`, `mark` too.

    A key may have several texts: `mark`, a 64-bit hash of the text, tells which one a span is of. Such a key's further texts come behind all keys.

    Positions count characters. Of runs of `LEAST_WORDS` words or more that are equal but for white space and ASCII case the first by key, then
    position, stays; of lines linked by a Jaccard similarity of 0.8 or more, directly or through others, the first of their component.
    Removed spans of a text may overlap or lie inside one another. Null and empty texts have no passages. Rows with a null key are left out; a
    row given twice counts once. Extra columns are ignored, and a table without repeats, or without rows, gives no rows.
    """
    made: list[str] = []
    spark = docs.sparkSession
    more_at: list[str] = []
    slim, more = _numbered(docs, key, text, more_at)
    told, told_at = write_table(units(slim))
    every = told.filter("n is null").drop("n")
    lines = G.scratch(every.groupBy("a", "b").agg(F.min("id").alias("doc"), F.first("bands").alias("bands")), made)
    rows = lines.select(F.explode("bands").alias("group"), F.col("a").alias("id"))
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    colliding = G.scratch(rows.join(sizes.select("group"), "group").distinct(), made)
    members = G.scratch(G.merged(colliding, made), made)
    wanted = members.select("id").distinct()
    held = G.scratch(lines.join(wanted, lines["a"] == wanted["id"], "left_semi").select(F.col("doc").alias("id")).distinct(), made)
    # the documents that hold candidate lines are read again, and only the lines of those move
    texts = line_texts(slim, held).dropDuplicates(["id"]).withColumn("weight", F.lit(1).cast("bigint"))
    found = G.scratch(G.verify(members, texts, members.count(), SIMILARITY, line_sets, False).filter("mate is not null").select("id", "mate"), made)
    # a line's class is its component, or else its own words
    linked = G.components(found).withColumnRenamed("id", "a")
    repeated = G.scratch(_first(every).join(linked, "a", "left").filter("n > 1 or component is not null"), made)
    best = repeated.filter("component is not null").groupBy("component").agg(F.min("first").alias("kept"))
    keepers = repeated.join(best, "component", "left").select("a", "b", F.coalesce("kept", "first").alias("kept"))
    gone, own = write_table(_later(every, keepers).withColumn("line", F.lit(1)))
    for place in made:
        drop_table(spark, place)
    made = [own, told_at]
    gone = gone.unionByName(passages(slim, told.filter("n is not null").select("id", "n"), made).withColumn("line", F.lit(0)))
    out = _spans(gone)
    if marks:
        own = slim.select("id", F.xxhash64("_text").alias("mark")).distinct()
        out = out.join(own, "id")
    stands = more.select("id", "of")
    out = out.join(stands, "id", "left").withColumn("id", F.coalesce("of", "id")).drop("of")
    out = out.join(stands.select(F.col("id").alias("kept_id"), "of"), "kept_id", "left").withColumn("kept_id", F.coalesce("of", "kept_id")).drop("of")
    out = G.scratch(out.select(F.col("id").alias(key), "start", "end", "kept_id", "kept_start", *(["mark"] if marks else [])), [])
    for place in [*made, *more_at]:
        drop_table(spark, place)
    return out


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with the spans (doc_id, start, end) cut out of their texts, and `n_chars`, where there is one, counted again.

    Spans may say by `mark`, the 64-bit hash of the text, which text of a repeated doc_id they are of; others are of all. A line of which nothing but white space is left after a cut goes
    with its line feed; other lines, blank ones too, stay as they are. A document of which nothing but white space would be left keeps its row,
    with an empty text. Rows without spans, null keys and null texts stay as they are, and so do all other columns, whatever their names.
    """
    cut, left, key, own = (fresh(docs, c) for c in ("_cuts", "_left", "_of", "_mark"))
    fields = F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut)
    if "mark" in spans.columns:
        cuts = spans.groupBy(F.col("doc_id").alias(key), F.col("mark").alias(own)).agg(fields)
        same = (docs["doc_id"] == cuts[key]) & (F.xxhash64(docs["text"]) == cuts[own])
    else:
        cuts = spans.groupBy(F.col("doc_id").alias(key)).agg(fields)
        same = docs["doc_id"] == cuts[key]
    joined = docs.join(cuts, same, "left").select(*[docs[f"`{c}`"] for c in docs.columns], cuts[cut])
    schema = StructType([*joined.schema.fields, StructField(left, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = T.columns_of(batch, "text", cut)
            for a, b in T.slices(texts):
                told = [_cut_out(t, [(c["start"], c["end"]) for c in own]) if t and own else t for t, own in zip(texts[a:b].to_pylist(), cuts[a:b].to_pylist())]
                yield batch.slice(a, b - a).append_column(left, pa.array(told, pa.string()))

    out = joined.mapInArrow(run, schema).withColumn("text", F.col(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"`{c}`" for c in docs.columns])


def _cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    scar = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text)
    out, at = [], 0
    for start, end in spans:
        if start > at:
            out += [text[at:start], scar]
        elif not out:
            out.append(scar)
        at = max(at, end)
    out.append(text[at:])
    lines = [line.replace(scar, "") for line in "".join(out).split("\n") if scar not in line or line.replace(scar, "").strip()]
    return "\n".join(lines) if any(line.strip() for line in lines) else ""


@query("op5_paragraph_dedup")
def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
