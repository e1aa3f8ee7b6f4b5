"""Graphs of repositories that are small enough for one task each: cycles, depths and communities without rounds.

A repository with at most `EDGES` edges is one group of bounded size, and millions of them spread over all tasks in one shuffle. Larger ones go
through the rounds of `graph`, with the same results but for communities (see `graph.modularity_communities`).
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = 100_000


def by_size(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of small repositories, and those of large ones."""
    counts = edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("_edges"))
    sized = edges.join(counts, "repo_id")
    return sized.filter(F.col("_edges") <= EDGES).drop("_edges"), sized.filter(F.col("_edges") > EDGES).drop("_edges")


def _numbered(told: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The names in order, and the numbers of every edge's source and target."""
    source, target = (np.array(told[c].to_pylist(), object) for c in ("source", "target"))
    names, number = np.unique(np.concatenate([source, target]).astype(str), return_inverse=True)
    return names.tolist(), number[: len(source)], number[len(source) :]


def components_in_order(n: int, source: np.ndarray, target: np.ndarray) -> tuple[list[int], list[int]]:
    """The strongly connected component of each vertex, and the length of the longest way down from each component; targets come first."""
    order = np.argsort(source, kind="stable")
    at, ahead = np.searchsorted(source[order], np.arange(n + 1)).tolist(), target[order].tolist()
    seen, low, component, depth = [0] * n, [0] * n, [-1] * n, []
    now, path = 0, []
    for root in range(n):
        if seen[root]:
            continue
        calls = [(root, at[root])]
        while calls:
            v, k = calls.pop()
            if not seen[v]:
                now += 1
                seen[v] = low[v] = now
                path.append(v)
            elif k > at[v]:  # back from the edge before
                low[v] = min(low[v], low[ahead[k - 1]]) if component[ahead[k - 1]] < 0 else low[v]
            while k < at[v + 1] and seen[ahead[k]]:
                if component[ahead[k]] < 0:
                    low[v] = min(low[v], seen[ahead[k]])
                k += 1
            if k < at[v + 1]:
                calls += [(v, k + 1), (ahead[k], at[ahead[k]])]
            elif low[v] == seen[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(path.pop())
                    component[members[-1]] = len(depth)
                below = (depth[component[t]] for m in members for t in ahead[at[m] : at[m + 1]] if component[t] != len(depth))
                depth.append(1 + max(below, default=-1))
    return component, depth


def placed_vertices(edges: DataFrame) -> DataFrame:
    """(repo_id, path, scc, size, depth) of every vertex: its component by its smallest member, how many are in it, and its depth."""

    def run(told: pa.Table) -> pa.Table:
        names, source, target = _numbered(told)
        component, depth = components_in_order(len(names), source, target)
        own, first, size = np.unique(component, return_index=True, return_counts=True)
        assert len(own) == len(depth)
        return pa.table({
            "repo_id": pa.array([told["repo_id"][0].as_py()] * len(names), pa.string()), "path": pa.array(names, pa.string()),
            "scc": pa.array([names[first[c]] for c in component], pa.string()), "size": pa.array([int(size[c]) for c in component], pa.int64()),
            "depth": pa.array([depth[c] for c in component], pa.int32())})

    return edges.select("repo_id", "source", "target").groupBy("repo_id").applyInArrow(run, "repo_id string, path string, scc string, size bigint, depth int")


def greedy_communities(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """The community of each vertex, by its smallest member: the pair of communities whose union raises modularity most is united, until none does.

    Twice the number of edges times the edges between two, less the product of their degrees, is what a union is worth: whole numbers, so that equal
    ones are known to be equal, and of these the pair with the smallest members goes first.
    """
    between: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b in pairs:
        between[a][b] = between[b][a] = 1
    degree = [len(b) for b in between]
    total, alive, root = 2 * len(pairs), [True] * n, list(range(n))
    worth = lambda i, j: total * between[i][j] - degree[i] * degree[j]
    heap = [(-worth(a, b), a, b) for a, b in pairs if a < b] + [(-worth(b, a), b, a) for a, b in pairs if b < a]
    heapq.heapify(heap)
    while heap:
        value, i, j = heapq.heappop(heap)
        if value >= 0:
            break
        if not (alive[i] and alive[j]) or worth(i, j) != -value:
            continue
        alive[j], root[j] = False, i
        for k, w in between[j].items():
            del between[k][j]
            if k != i:
                between[i][k] = between[k][i] = between[i].get(k, 0) + w
        degree[i] += degree[j]
        for k in between[i]:
            a, b = min(i, k), max(i, k)
            heapq.heappush(heap, (-worth(a, b), a, b))
    for v in range(n):  # a smaller member's community is known by then
        root[v] = v if root[v] == v else root[root[v]]
    return root


def greedy_members(edges: DataFrame) -> DataFrame:
    """(repo_id, path, community) of every vertex, with directions of edges and repeated edges left aside."""

    def run(told: pa.Table) -> pa.Table:
        names, source, target = _numbered(told)
        pairs = sorted({(min(a, b), max(a, b)) for a, b in zip(source.tolist(), target.tolist()) if a != b})
        found = greedy_communities(len(names), pairs)
        return pa.table({"repo_id": pa.array([told["repo_id"][0].as_py()] * len(names), pa.string()), "path": pa.array(names, pa.string()), "community": pa.array([names[c] for c in found], pa.string())})

    return edges.select("repo_id", "source", "target").groupBy("repo_id").applyInArrow(run, "repo_id string, path string, community string")
