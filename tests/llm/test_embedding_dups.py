import math

import numpy as np
import pytest

from buildlore.llm import embedding_dups as E

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    vectors = {}
    for i, v, _ in rows:
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vectors[i] = np.array(v, np.float32).astype(float) if ok else None
    link = {i: set() for i in vectors}
    for a, x in vectors.items():
        for b, y in vectors.items():
            if a < b and x is not None and y is not None and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                link[a].add(b)
                link[b].add(a)
    out = {}
    for i in vectors:
        seen, edge = {i}, [i]
        while edge:
            edge = [y for x in edge for y in link[x] if y not in seen and not seen.add(y)]
        out[i] = (len(link[i]), min(seen), min(seen) == i)
    return out


def clustered(n, seed, spread):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(6, 8))
    return [(i, (heads[rng.integers(6)] * rng.uniform(0.1, 9) + rng.normal(size=8) * spread).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize("spread", [0.1, 0.5, 3.0])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(E, "BLOCK_NUMBERS", 8)  # blocks of 256 vectors, the least
    rows = clustered(700, 4, spread)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "'x' AS v", "2 AS weight", "3 AS leaf", "4 AS task")
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.links(df).collect()} == brute(rows)


def test_odd_vectors(spark):
    good = [1.0, 2.0]
    rows = [(1, good, 0), (2, good, 1), (3, [2.0, 4.0], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [1.0], 0), (10, [], 0), (11, [1e-30, 2e-30], 0), (12, [1e30, 2e30], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.links(spark.createDataFrame(rows + [(1, good, 0), (None, good, 0)], SCHEMA)).collect()}
    assert got == brute(rows)
    assert got[12] == (4, 1, False)
    assert E.links(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in E.links(spark.createDataFrame([(3, None, 0)], SCHEMA)).collect()] == [(3, 0, 3, True)]


def test_traversal_covers_every_close_pair_once():
    rng = np.random.default_rng(1)
    x = E._unit(np.concatenate([rng.normal(size=(300, 4)), rng.normal(size=(1, 4)) + 0.1 * rng.normal(size=(200, 4))]))
    tree = E.build_tree(x[::9])
    leaf = tree.leaves(x)
    above = np.full((len(x), len(tree.parent)), False)
    for i, node in enumerate(leaf):
        while node >= 0:
            above[i, node] = True
            node = tree.parent[node]
    count = above.sum(axis=0)
    radius = np.array([np.linalg.norm(x[above[:, k]] - tree.centre[k], axis=1).max(initial=0) for k in range(len(tree.parent))])
    reach = math.sqrt(0.2)
    met = np.zeros((len(x), len(x)), int)
    pairs = E.traverse(tree, radius, count, reach, 20)
    for a, b in pairs:
        own = np.outer(above[:, a], above[:, b])
        met += own | own.T
    close = np.linalg.norm(x[:, None] - x[None], axis=2) <= reach
    assert (met[close] == 1).all() and met.max() == 1
    assert (met == 0).any(), "nothing was pruned"


def test_levels_are_nested_nets():
    x = E._unit(np.random.default_rng(2).normal(size=(60, 3)))
    tree = E.build_tree(x)
    for k in range(1, len(tree.parent)):
        if tree.level[k] > 1:
            assert np.linalg.norm(tree.centre[k] - tree.centre[tree.parent[k]]) <= 2 / 2 ** (tree.level[k] - 1) + 1e-9
