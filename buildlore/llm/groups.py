"""Exact verification of candidate groups of token sets: link counts and spanning links, never a list of all pairs.

A set may stand in several candidate groups. Groups with the same members are looked at once, and a pair of sets that meets in several groups
counts only in the first of them, which both rows can tell from their own lists of groups. Large groups are cut into blocks, and each task
compares two blocks; small groups are packed, many to a task. So no task holds more than a bounded number of sets whatever a group's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlore.llm.texts import mix, release
from buildlore.operators.graph import connected_components
from buildlore.session import write_table

BLOCK = 1536  # sets of a block; a task has two
PACK = 2048  # sets of small groups that a task takes together, about
COLUMNS = 2048  # tokens that are multiplied at a time
FILTER_BITS = 1 << 26


def distinct_groups(members: DataFrame) -> DataFrame:
    """(group, id, n) of the groups of two or more, one for each set of members."""
    told = members.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("id", F.lit(7)) % 1000000007).alias("b"),
    ).filter("n > 1")
    first = told.groupBy("n", "a", "b").agg(F.min("group").alias("group")).select("group", "n")
    return members.join(first, "group")


def tasks(members: DataFrame, rows: int) -> DataFrame:
    """Each member with the tasks that need it: its pack, or one for each block that its own block is compared with."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    packs = max(1, -(-rows // PACK))
    own = F.pmod(F.xxhash64("id", "group"), F.col("_blocks")).cast("int")
    small = F.array(F.struct(F.xxhash64(F.pmod(F.xxhash64("group"), F.lit(packs))).alias("task"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    pair = lambda k: F.struct(F.xxhash64("group", F.least(k, F.col("_own")), F.greatest(k, F.col("_own"))).alias("task"), F.least(k, F.col("_own")).alias("i"), F.greatest(k, F.col("_own")).alias("j"))
    large = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), pair)
    out = members.withColumn("_blocks", blocks).withColumn("_own", own)
    return out.withColumn("_t", F.explode(F.when(F.col("_blocks") == 1, small).otherwise(large))).select("group", "id", F.col("_own").alias("own"), "_t.task", "_t.i", "_t.j")


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of `a` has in common with each of `b`; sets are sorted and distinct."""
    both = a if b is a else a + b
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    token, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    keep = count[column] > 1  # tokens of one set alone are in no intersection
    number = np.cumsum(count > 1) - 1
    row, column = row[keep], number[column[keep]]
    width = int(number[-1]) + 1 if len(number) else 0
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(both), min(COLUMNS, width - start)), np.float32)
        dense[row[lo:hi], column[lo:hi] - start] = 1
        out += dense[: len(a)] @ dense[0 if b is a else len(a) :].T
    return out


def _met_before(group: int, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray | None:
    """Which pairs share a group that comes before this one."""
    found = [np.concatenate([g[g < group] for g in side]) if side else np.zeros(0, np.int64) for side in (a, b)]
    common = np.intersect1d(*found)
    if not len(common):
        return None
    marks = []
    for side in (a, b):
        m = np.zeros((len(side), len(common)), np.float32)
        for i, g in enumerate(side):
            at = np.searchsorted(common, g)
            at = at[(at < len(common)) & (common[np.minimum(at, len(common) - 1)] == g)]
            m[i, at] = 1
        marks.append(m)
    return (marks[0] @ marks[1].T) > 0


def _roots(link: np.ndarray) -> np.ndarray:
    """The first member of each member's component in a symmetric matrix of links."""
    root = np.full(len(link), -1)
    for start in range(len(link)):
        if root[start] >= 0:
            continue
        root[start] = start
        edge = np.array([start])
        while len(edge):
            new = np.flatnonzero(link[edge].any(axis=0) & (root < 0))
            root[new] = start
            edge = new
    return root


def _compare(group: int, ids: np.ndarray, sets: list, lists: list | None, weight: np.ndarray, own: np.ndarray, i: int, j: int, least: Fraction):
    """(ids, links) of members with links, and (id, mate) spanning links, of one group or one pair of its blocks."""
    one = i == j
    left, right = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(own == i), np.flatnonzero(own == j))
    if not len(left) or not len(right):
        return None
    a = [sets[k] for k in left]
    b = a if one else [sets[k] for k in right]
    inter = _shared(a, b)
    size_a, size_b = np.array([len(s) for s in a], np.float64), np.array([len(s) for s in b], np.float64)
    link = inter * least.denominator >= least.numerator * (size_a[:, None] + size_b[None, :] - inter) - 1e-6
    link &= ids[left][:, None] != ids[right][None, :]
    met = _met_before(group, [lists[k] for k in left], [lists[k] for k in right]) if lists is not None else None
    if met is not None:
        link &= ~met
    if not link.any():
        return None
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, left, link @ weight[right])
    if not one:
        np.add.at(links, right, link.T @ weight[left])
        full = np.zeros((len(ids), len(ids)), bool)
        full[np.ix_(left, right)] = link
        link = full | full.T
    root = _roots(link)
    joined = np.flatnonzero(root != np.arange(len(ids)))
    has = np.flatnonzero(links)
    return (ids[has], links[has]), (ids[joined], ids[root[joined]])


def verify(members: DataFrame, texts: DataFrame, rows: int, least: Fraction, sets_of: Callable[[pa.Array], list[np.ndarray]], count: bool = True) -> DataFrame:
    """(id, mate, links) from `members` (group, id, n) and `texts` (id, text, weight): the pairs whose Jaccard similarity is `least` or more.

    `sets_of` makes a text's set of sorted distinct tokens; texts move and not sets, as they are smaller. Rows with a mate are spanning links:
    the components of the links are those of these rows. Rows without one add the weights of the linked sets to their id. Every pair that
    meets in a group is compared exactly, and counted once. Without `count` there are spanning links only, and no lists of groups move.
    """
    payload = texts
    if count:
        lists = members.groupBy("id").agg(F.sort_array(F.collect_list("group")).alias("groups"))  # as many as the sets' runs gave it
        payload = texts.join(lists, "id")
    full = tasks(members, rows).join(payload, "id")

    def compared(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group, ids, own, weight = (table[c].to_numpy() for c in ("group", "id", "own", "weight"))
        i, j = int(table["i"][0].as_py()), int(table["j"][0].as_py())

        own_groups = None
        if count:
            column = table["groups"].chunk(0)
            at, flat = np.asarray(column.offsets), np.asarray(column.values)
            own_groups = [flat[x:y] for x, y in zip(at[:-1], at[1:])]
        tokens = sets_of(table["text"].chunk(0))
        found_ids, found_mates, found_links = [], [], []
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            told = _compare(int(group[part[0]]), ids[part], [tokens[k] for k in part], [own_groups[k] for k in part] if count else None, weight[part], own[part], i, j, least)
            if told:
                (has, links), (who, mate) = told
                if not count:
                    has, links = has[:0], links[:0]
                found_ids += [has, who]
                found_mates += [np.full(len(has), -1), mate]
                found_links += [links, np.zeros(len(who), np.int64)]
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        mates = cat(found_mates)
        alone = np.concatenate([np.full(len(m), k % 2 == 0) for k, m in enumerate(found_mates)]) if found_mates else np.zeros(0, bool)
        return pa.table({"id": pa.array(cat(found_ids), pa.int64()), "mate": pa.array(mates, pa.int64(), mask=alone), "links": pa.array(cat(found_links), pa.int64())})

    def run(table: pa.Table) -> pa.Table:
        out = compared(table)
        release()
        return out

    return full.groupBy("task").applyInArrow(run, "id bigint, mate bigint, links bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (id, mate): the smallest id it is connected with."""
    found = connected_components(edges.select(F.lit("").alias("repo_id"), F.col("id").alias("source"), F.col("mate").alias("target")))
    return found.select(F.col("path").alias("id"), "component")


def merged(members: DataFrame, made: list[str]) -> DataFrame:
    """(group, id, n) of `members` (group, id), whose overlapping groups become one: every id is in one group, named by its smallest id.

    For groups of sets that are much alike, as those of one group are often in many others with nearly the same members; all pairs of the
    old groups are in the new ones.
    """
    heads = members.groupBy("group").agg(F.min("id").alias("mate"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("group", "mate")
    found = scratch(components(members.join(heads, "group").filter("id <> mate").select("id", "mate").distinct()), made)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return found.join(sizes, "component").select(F.col("component").alias("group"), "id", "n")


def scratch(df: DataFrame, made: list[str]) -> DataFrame:
    """`df` written once to the cluster's shared folder; `made` remembers where."""
    out, place = write_table(df)
    made.append(place)
    return out


class Likely:
    """A Bloom filter over ids that tasks read: it holds all of them, and few others unless they are too many for `FILTER_BITS` bits."""

    def __init__(self, shared, bits: int):
        self.shared, self.bits = shared, bits

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
        shift = np.uint64(64 - (bits.bit_length() - 1))
        return [mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) >> shift for k in range(4)]

    def holds(self, ids: np.ndarray) -> np.ndarray:
        keep = np.ones(len(ids), bool)
        for at in self.places(ids, self.bits):
            keep &= (self.shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return keep


def likely(ids: DataFrame) -> Likely:
    """A filter of the distinct `ids` (id); of at most `FILTER_BITS` bits, so that it takes in more other ids the more there are."""
    n = max(1, ids.count())
    bits = min(FILTER_BITS, 1 << max(10, (n * 12).bit_length()))

    def run(batches):
        for batch in batches:
            at = np.concatenate(Likely.places(batch.column(0).to_numpy(), bits)).astype(np.int64)
            word, own = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, own, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(value.view(np.int64))], ["word", "bits"])

    told = ids.mapInArrow(run, "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    filled = np.zeros(bits // 64, np.int64)
    filled[told["word"].to_numpy()] = told["bits"].to_numpy()
    return Likely(ids.sparkSession.sparkContext.broadcast(filled.view(np.uint8)), bits)


def likely_batches(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """`likely_members` for rows that tasks read in Python: the rows, and what the reading function does to its batches first.

    So one worker does both. Two in a row are two workers a core, and each lives on after its task.
    """
    if ids.count() * 8 > FILTER_BITS:
        return rows.join(ids, "id", "left_semi"), lambda batches: batches
    wanted = likely(ids)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(wanted.holds(batch.column(batch.schema.get_field_index("id")).to_numpy())))

    return rows, keep


def likely_members(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, ...) whose id is among the distinct `ids`, and few others: for a join that follows and should not move every text.

    A Bloom filter of at most `FILTER_BITS` bits is read by the tasks that scan. Ids too many for it are joined instead.
    """
    n = max(1, ids.count())
    if n * 8 > FILTER_BITS:
        return rows.join(ids, "id", "left_semi")
    bits = min(FILTER_BITS, 1 << max(10, (n * 12).bit_length()))
    at = [F.shiftrightunsigned(F.xxhash64("id", F.lit(k)), 64 - (bits.bit_length() - 1)) for k in range(4)]
    words = ids.select(F.explode(F.array(*at)).alias("at")).select(F.shiftright("at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    told = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    filled = np.zeros(bits // 64, np.int64)
    filled[told["word"].to_numpy()] = told["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(filled.view(np.uint8))
    names = rows.columns
    hashed = rows.select("*", *[a.alias(f"_at{k}") for k, a in enumerate(at)])

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k in range(4):
                at = batch.column(batch.schema.get_field_index(f"_at{k}")).to_numpy()
                keep &= (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield batch.select(names).filter(pa.array(keep))

    return hashed.mapInArrow(run, rows.schema)
