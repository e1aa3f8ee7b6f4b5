"""Embedding near-duplicates by dual traversal of a cover tree: all pairs of vectors with a cosine at the threshold or above, exactly.

Vectors become points of the unit sphere. A bounded sample gives nested levels of centres whose radii halve from level to level; every vector
goes down from centre to nearest centre, and each node's covering radius is measured over all vectors below it. The dual traversal starts with
the root against itself, drops a pair of nodes whose centres lie farther apart than their covering radii and the threshold's distance allow,
opens nodes that hold many vectors, and leaves node pairs to compare. Nodes of many vectors are cut into blocks, and each task compares two
blocks and keeps counts and spanning links only. Pruning is exact, since covering radii are; how much is pruned depends on how clustered the
vectors are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlore.llm import groups as G
from buildlore.llm import texts as T
from buildlore.llm.base import query, table
from buildlore.session import drop_table

COSINE = 0.9
BLOCK_NUMBERS = 1 << 19  # of a block's vectors together; a task has two blocks
SAMPLE_ROWS = 1024  # the bound of the sample whose members become centres
LEVELS = 8  # radii 2, 1, 1/2, ... 1/64
STRIP = 512  # rows compared at a time
PAIRS = 1 << 14  # pairs that are compared again in double precision at a time


@dataclass(frozen=True)
class Tree:
    """Nodes in order of level: centre, level, parent; a child of a node may have the node's own centre, as in a nested net."""

    centre: np.ndarray
    level: np.ndarray
    parent: np.ndarray

    def children(self) -> list[np.ndarray]:
        order = np.argsort(self.parent, kind="stable")
        at = np.searchsorted(self.parent[order], np.arange(len(self.parent) + 1))
        return [order[a:b] for a, b in zip(at[:-1], at[1:])]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down to the nearest child, again and again."""
        node, child = np.zeros(len(x), np.int64), self.children()
        for _ in range(LEVELS):
            for k in np.unique(node):
                if len(child[k]) > 1:
                    mine = node == k
                    node[mine] = child[k][np.argmax(x[mine] @ self.centre[child[k]].T, axis=1)]
                elif len(child[k]):
                    node[node == k] = child[k][0]
        return node


def build_tree(sample: np.ndarray) -> Tree:
    """Nested levels over unit vectors: a level's centres are more than its radius apart, and each lies within its parent's radius."""
    centre, level, parent = [0], [0], [-1]
    above = {0: np.arange(len(sample))}  # the sample's members below each node of the level above
    for depth in range(1, LEVELS):
        radius, below = 2.0 / 2**depth, {}
        for node, members in above.items():
            if len(members) < 2:
                continue
            left = members
            while len(left):
                head = centre[node] if centre[node] in left else left[0]
                near = np.linalg.norm(sample[left] - sample[head], axis=1) <= radius
                centre.append(head)
                level.append(depth)
                parent.append(node)
                below[len(centre) - 1] = left[near]
                left = left[~near]
        above = below
    return Tree(sample[centre], np.array(level), np.array(parent))


def traverse(tree: Tree, radius: np.ndarray, count: np.ndarray, reach: float, block: int) -> list[tuple[int, int]]:
    """The node pairs left to compare: each pair of vectors within reach is below exactly one of them. Nodes of at most `block` vectors stay shut."""
    child, out, stack = tree.children(), [], [(0, 0)]
    while stack:
        a, b = stack.pop()
        if not count[a] or not count[b]:
            continue
        if a != b and np.linalg.norm(tree.centre[a] - tree.centre[b]) > radius[a] + radius[b] + reach + 1e-6:
            continue
        shut_a, shut_b = (count[k] <= block or not len(child[k]) for k in (a, b))
        if a == b:
            if shut_a:
                out.append((a, a))
            else:
                own = child[a]
                stack += [(int(own[i]), int(own[j])) for i in range(len(own)) for j in range(i, len(own))]
        elif shut_a and shut_b:
            out.append((a, b))
        elif shut_b or (not shut_a and count[a] >= count[b]):
            stack += [(int(c), b) for c in child[a]]
        else:
            stack += [(a, int(c)) for c in child[b]]
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # a power of two brings any size into range without changing a digit
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of the pairs of unit vectors at the threshold: single precision first, and what is near the threshold again in double."""
    one = b is None
    b = a if one else b
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    left, right = [], []
    for start in range(0, len(a), STRIP):
        near = fa[start : start + STRIP] @ fb.T >= np.float32(COSINE - 1e-4)
        i, j = np.nonzero(near)
        i += start
        if one:
            i, j = i[i < j], j[i < j]
        parts = [slice(k, k + PAIRS) for k in range(0, max(1, len(i)), PAIRS)]
        sure = np.concatenate([np.einsum("ij,ij->i", a[i[p]], b[j[p]]) >= COSINE for p in parts])
        left.append(i[sure])
        right.append(j[sure])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row number each row is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compared(table: pa.Table) -> pa.Table:
    """Counts and spanning links of one task: one block with itself, or two blocks with each other."""
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    ids, side, weight = (table[c].to_numpy()[order] for c in ("id", "side", "weight"))
    x = _unit(_matrix(table["v"])[order])
    one = bool(table["alone"][0].as_py())
    a, b = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    i, j = compare(x[a], None if one else x[b])
    i, j = a[i], b[j]
    links = np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
    root = _forest(len(ids), i, j)
    has, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({
        "id": pa.array(np.r_[ids[has], ids[joined]], pa.int64()),
        "mate": pa.array(np.r_[ids[has], ids[root[joined]]], pa.int64(), mask=np.r_[np.ones(len(has), bool), np.zeros(len(joined), bool)]),
        "links": pa.array(np.r_[links[has], np.zeros(len(joined), np.int64)], pa.int64()),
    })


def _placed(vectors: DataFrame, tree: Tree) -> DataFrame:
    """(id, weight, v, leaf, far): each vector's leaf, and its distance to the centre of every node above it, root first."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches):
        t = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, weight, v = T.columns_of(batch, "id", "weight", "v")
            x = _unit(_matrix(v))
            leaf = t.leaves(x)
            far, node = np.full((len(x), LEVELS), -1.0), leaf.copy()
            while (node >= 0).any():
                on = node >= 0
                far[on, t.level[node[on]]] = np.linalg.norm(x[on] - t.centre[node[on]], axis=1)
                node[on] = t.parent[node[on]]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * LEVELS), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([ids, weight, v, pa.array(leaf.astype(np.int32)), rows], ["id", "weight", "v", "leaf", "far"])

    return vectors.mapInArrow(run, f"id bigint, weight bigint, v {kind}, leaf int, far array<double>")


def links(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row with a key: how many other vectors it links with, the smallest key it is connected with.

    Vectors link at a cosine of 0.9 or more in double precision. Null and zero vectors, and vectors that hold nulls or numbers that are not
    finite, link with nothing; so do vectors of another length than the most common one (of equally common ones the smallest), which have no
    cosine with the others. Equal vectors are compared once, by their number. A key given twice with the same vector counts once; with several
    vectors it joins their components and takes the largest count. Rows with a null key are left out, other columns are ignored.
    """
    made: list[str] = []
    spark = rows.sparkSession
    slim = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    usable = slim.filter(F.col("v").isNotNull()).filter(~F.coalesce(bad, F.lit(True)))
    sizes = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    usable = usable.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))
    distinct = usable.dropDuplicates(["id", "v"])
    reps = G.scratch(distinct.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).select("id", "weight", "v"), made)
    n = reps.count()
    all_ids = slim.select("id").distinct()
    if not n:
        return all_ids.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    block = max(256, BLOCK_NUMBERS // sizes[0]["n"])
    few = min(SAMPLE_ROWS, max(16, n // block))
    sample = _unit(_matrix(reps.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(few).toArrow()["v"]))
    tree = build_tree(sample)
    placed = G.scratch(_placed(reps, tree), made)
    # no more rows than the tree has leaves come to the driver
    seen = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.element_at("far", k + 1)).alias(f"r{k}") for k in range(LEVELS)]).collect()
    count, radius = np.zeros(len(tree.parent), np.int64), np.zeros(len(tree.parent))
    for row in seen:
        node = row["leaf"]
        while node >= 0:
            count[node] += row["n"]
            radius[node] = max(radius[node], row[f"r{tree.level[node]}"])
            node = tree.parent[node]
    pairs = traverse(tree, radius, count, math.sqrt(2 - 2 * COSINE), block)
    out = _exchange(placed, tree, count, pairs, block).groupBy("task").applyInArrow(_compared, "id bigint, mate bigint, links bigint")
    found = G.scratch(out, made)
    total = found.filter("mate is null").groupBy("id").agg(F.sum("links").alias("links"))
    connected = G.components(found.filter("mate is not null").select("id", "mate"))
    told = reps.join(total, "id", "left").join(connected, "id", "left").select("v", F.coalesce("component", "id").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("k"))
    per = usable.join(told, "v").groupBy("id").agg(F.min("c").alias("c"), F.max("k").alias("k"))
    final = all_ids.join(per, "id", "left").select(F.col("id").alias(key), F.coalesce("k", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    final = G.scratch(final.withColumn("kept", F.col(key) == F.col("component_id")), [])
    for place in made:
        drop_table(spark, place)
    return final


def _exchange(placed: DataFrame, tree: Tree, count: np.ndarray, pairs: list[tuple[int, int]], block: int) -> DataFrame:
    """(task, alone, side, id, weight, v): each vector in every task that compares its block, for the node pairs left by the traversal.

    A vector belongs to one shut node of the pairs, at most, on each level; which tasks its block is in follows from that node and block.
    """
    spark = placed.sparkSession
    blocks = {int(k): max(1, -(-int(count[k]) // block)) for pair in pairs for k in pair}
    above = {}
    for leaf in range(len(tree.parent)):
        node = leaf
        while node >= 0:
            if node in blocks:
                above.setdefault(leaf, []).append(node)
            node = int(tree.parent[node])
    # a row for each leaf and node pair above it: bounded by the tree, not by the vectors
    facts = []
    partners: dict[int, list[tuple[int, int]]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append((b, 0))
        if a != b:
            partners.setdefault(b, []).append((a, 1))
    for leaf, nodes in above.items():
        facts += [(leaf, node, other, side, blocks[node], blocks[other]) for node in nodes for other, side in partners[node]]
    plan = spark.createDataFrame(facts, "leaf int, node int, other int, side int, mine int, theirs int")
    own = F.pmod(F.xxhash64("id", "node"), F.col("mine")).cast("int")
    rows = placed.select("id", "weight", "v", "leaf").join(plan, "leaf").withColumn("own", own)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    same = F.col("node") == F.col("other")
    first = F.when(same, F.least("own", "k")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("k"))
    second = F.when(same, F.greatest("own", "k")).when(F.col("side") == 0, F.col("k")).otherwise(F.col("own"))
    task = F.xxhash64(F.when(F.col("side") == 0, F.col("node")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("node")), first, second)
    side = F.when(same, (F.col("own") == second).cast("int")).otherwise(F.col("side"))
    return rows.select(task.alias("task"), (same & (first == second)).alias("alone"), side.alias("side"), "id", "weight", "v")


OP4_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS size FROM good),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n AS x JOIN n AS y ON x.vec_id <> y.vec_id AND x.size > 0 AND y.size > 0 AND list_dot_product(x.v, y.v) / (x.size * y.size) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, coalesce((SELECT min(least(a, b)) FROM reach WHERE a = vec_id), vec_id) AS component_id
  FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id IS NOT NULL) AS d)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c"""


@query("op4_embedding_dups", OP4_SQL)
def op4_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "embeddings"))
