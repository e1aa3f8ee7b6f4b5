import random

import numpy as np
import pytest
from plain import closure, components_of, propagate, scc_of, tiers_of

from buildlore.operators import graph as G
from buildlore.operators import repositories as R


def frame(spark, edges):
    return spark.createDataFrame([("r", a, b) for a, b in edges], "repo_id string, source string, target string")


def as_map(df, value):
    return {r["path"]: r[value] for r in df.collect()}


CASES = {
    "chain": {("a", "b"), ("b", "c")},
    "pair": {("a", "b"), ("b", "a")},
    "cycle above a chain": {("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("d", "c")},
    "nested cycles": {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("e", "g")},
}
for seed in range(3):
    rng = random.Random(seed)
    CASES[f"random {seed}"] = {(f"n{a:02d}", f"n{b:02d}") for a, b in ((rng.randrange(24), rng.randrange(24)) for _ in range(32)) if a != b}


def all_cases(spark):
    """Every case as one repository of the same job."""
    rows = [(name, a, b) for name, edges in CASES.items() for a, b in edges]
    return spark.createDataFrame(rows, "repo_id string, source string, target string")


def by_repo(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r["repo_id"], {})[r["path"]] = r[value]
    return out


@pytest.fixture(params=["a task each", "rounds"])
def way(request, monkeypatch):
    """Small repositories solved by a task each, or by rounds like large ones."""
    if request.param == "rounds":
        monkeypatch.setattr(R, "EDGES", 0)
    return request.param


def test_tiers(spark, way):
    got = G.tier_table(all_cases(spark))
    scc, tiers = by_repo(got, "scc"), by_repo(got, "tier_index")
    for name, edges in CASES.items():
        want = scc_of(edges)
        assert scc[name] == want
        assert tiers[name] == tiers_of(edges)
        assert all(want[a] == want[b] or tiers[name][a] > tiers[name][b] for a, b in edges)


def test_only_loops_and_no_edges(spark):
    none = G.valid_edges(frame(spark, {("a", "a")}))
    assert none.count() == 0
    assert G.strongly_connected(none).count() == 0
    assert G.tier_table(none).count() == 0


def test_isolated_and_degrees(spark):
    files = spark.createDataFrame([("r", p) for p in "abcz"], "repo_id string, path string")
    edges = frame(spark, {("a", "b"), ("b", "c"), ("a", "c")})
    assert [r["path"] for r in G.isolated(files, edges).collect()] == ["z"]
    assert {r["path"]: (r["dependencies"], r["dependents"]) for r in G.degrees(files, edges).collect()} == {"a": (2, 0), "b": (1, 1), "c": (0, 2), "z": (0, 0)}


def test_connected_components(spark):
    assert by_repo(G.connected_components(all_cases(spark)), "component") == {n: components_of(e) for n, e in CASES.items()}


def test_long_chain_is_one_component(spark):
    edges = {(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)}
    assert set(as_map(G.connected_components(frame(spark, edges)), "component").values()) == {"n000"}


def test_communities_match_plain_version(spark):
    nodes = {n: sorted({x for e in edges for x in e} | {"zz"}) for n, edges in CASES.items()}
    df = spark.createDataFrame([(r, p) for r, ps in nodes.items() for p in ps], "repo_id string, path string")
    assert by_repo(G.communities(all_cases(spark), df), "community") == {n: propagate(n, nodes[n], e) for n, e in CASES.items()}


def test_unknown_file_takes_its_neighbours_domain(spark):
    edges = {("app/a", "x/odd"), ("app/b", "x/odd"), ("app/c", "x/odd")}
    nodes = spark.createDataFrame([("r", p) for p in ("app/a", "app/b", "app/c", "x/odd", "x/alone")], "repo_id string, path string")
    named = G.communities(frame(spark, edges), nodes).selectExpr("*", "CASE WHEN path LIKE 'app/%' THEN 'backend' ELSE 'uncategorized' END AS domain")
    assert as_map(G.community_vote(named), "domain") == {"x/odd": "backend", "x/alone": "uncategorized"}


def test_vote_needs_half(spark):
    rows = [("r", "a", "c", "docs"), ("r", "b", "c", "core"), ("r", "d", "c", "tests"), ("r", "x", "c", "uncategorized")]
    df = spark.createDataFrame(rows, "repo_id string, path string, community string, domain string")
    assert as_map(G.community_vote(df), "domain") == {"x": "uncategorized"}


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(R, "EDGES", 0)
    n = 5000
    name = lambda i: f"v{(i * 7919) % n:05d}"
    chain = [("chain", name(i), name(i + 1)) for i in range(n - 1)]
    circle = [("circle", name(i), name((i + 1) % n)) for i in range(n)]
    # a cycle with a way in, a way out and a chord
    mixed = [("mixed", f"m{i:04d}", f"m{(i + 1) % 900:04d}") for i in range(900)] + [("mixed", "m0100", "m0500"), ("mixed", "in", "m0003"), ("mixed", "m0700", "out")]
    edges = spark.createDataFrame(chain + circle + mixed, "repo_id string, source string, target string").coalesce(4)
    rounds = []
    store = G._store
    monkeypatch.setattr(G, "_store", lambda *a: rounds.append(1) or store(*a))
    scc = {(r.repo_id, r.path): (r.scc, r.size) for r in G.strongly_connected(edges).collect()}
    assert len(rounds) <= 40
    assert scc == {("circle", name(i)): ("v00000", n) for i in range(n)} | {("mixed", f"m{i:04d}"): ("m0000", 900) for i in range(900)}
    rounds.clear()
    line = edges.filter("repo_id = 'chain'")
    depth = as_map(G.longest_depth(line, G.vertices(line)), "depth")
    assert len(rounds) <= 40
    assert depth == {name(i): n - 1 - i for i in range(n)}


def test_communities_are_a_fixpoint(spark):
    edges = {(f"p{i:02d}", f"p{i + 1:02d}") for i in range(49)} | {("x", "y"), ("y", "z"), ("x", "z"), ("b1", "b2"), ("b1", "b3"), ("b4", "b2"), ("b4", "b3")}
    nodes = spark.createDataFrame([("r", v) for v in sorted({v for e in edges for v in e} | {"alone"})], "repo_id string, path string")
    got = as_map(G.communities(frame(spark, edges), nodes), "community")
    for v in got:
        near = [got[b if a == v else a] for a, b in edges if v in (a, b)] + [got[v]]
        assert got[v] == min(set(near), key=lambda c: (-near.count(c), c))
    assert got["alone"] == "alone" and got["x"] == got["y"] == got["z"]


def test_components_and_depths_of_any_graph():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 14)
        edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 30))) if a != b}
        source, target = (np.array([e[k] for e in sorted(edges)], np.int64) for k in range(2))
        component, depth = R.components_in_order(n, source, target)
        reach = closure(edges) | {v: set() for v in range(n) if not any(v in e for e in edges)}
        assert all((component[a] == component[b]) == (a == b or (b in reach[a] and a in reach[b])) for a in range(n) for b in range(n))
        below = {c: [depth[component[b]] for a, b in edges if component[a] == c != component[b]] for c in component}
        assert all(depth[c] == 1 + max(told, default=-1) for c, told in below.items())


def test_a_long_path_is_no_deep_recursion():
    n = 50_000
    component, depth = R.components_in_order(n, np.arange(n - 1), np.arange(1, n))
    assert len(set(component)) == n and depth[component[0]] == n - 1
    component, _ = R.components_in_order(n, np.arange(n), np.r_[np.arange(1, n), 0])
    assert set(component) == {0}


def modularity(edges, label):
    und = {tuple(sorted(e)) for e in edges}
    m, degree, inside = len(und), {}, {}
    for a, b in und:
        for v in (a, b):
            degree[label[v]] = degree.get(label[v], 0) + 1
        inside[label[a]] = inside.get(label[a], 0) + (label[a] == label[b])
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


def greedy(edges):
    """Agglomeration by the best union each time, tried one by one."""
    und = sorted({tuple(sorted(e)) for e in edges})
    label = {v: v for e in und for v in e}
    while True:
        degree = {}
        for e in und:
            for v in e:
                degree[label[v]] = degree.get(label[v], 0) + 1
        between = {}
        for a, b in und:
            pair = tuple(sorted((label[a], label[b])))
            if pair[0] != pair[1]:
                between[pair] = between.get(pair, 0) + 1
        worth = [(degree[i] * degree[j] - 2 * len(und) * k, i, j) for (i, j), k in between.items()]
        if not worth or min(worth)[0] >= 0:
            return label
        _, i, j = min(worth)
        label = {v: i if c == j else c for v, c in label.items()}


def planted(seed, groups, size):
    """Dense groups with a few edges between them."""
    rng = random.Random(seed)
    name = lambda g, k: f"g{g}/{k:02d}"
    edges = {(name(g, a), name(g, b)) for g in range(groups) for a in range(size) for b in range(size) if a != b and rng.random() < 0.4}
    return edges | {(name(g, rng.randrange(size)), name((g + 1) % groups, rng.randrange(size))) for g in range(groups) for _ in range(2)}


GRAPHS = CASES | {"planted": planted(1, 5, 12), "star": {("hub", f"leaf{i:02d}") for i in range(30)}, "path": {(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)}}


def found_communities(spark, graphs):
    rows = [(name, a, b) for name, edges in graphs.items() for a, b in edges]
    nodes = spark.createDataFrame([(n, v) for n, e in graphs.items() for v in sorted({x for p in e for x in p} | {"alone"})], "repo_id string, path string")
    return by_repo(G.modularity_communities(spark.createDataFrame(rows, "repo_id string, source string, target string"), nodes), "community")


def test_modularity_communities_are_the_greedy_ones(spark):
    got = found_communities(spark, GRAPHS)
    for name, edges in GRAPHS.items():
        assert got[name] == greedy(edges) | {"alone": "alone"}


def test_communities_by_rounds_are_as_good(spark, monkeypatch):
    monkeypatch.setattr(R, "EDGES", 0)
    graphs = {"planted": planted(1, 3, 8), "star": {("hub", f"leaf{i:02d}") for i in range(10)}, "path": {(f"p{i:02d}", f"p{i + 1:02d}") for i in range(14)}}
    got = found_communities(spark, graphs)
    for name, edges in graphs.items():
        label = got[name]
        assert label["alone"] == "alone" and all(label[c] == c and c == min(v for v in label if label[v] == c) for c in label.values())
        assert modularity(edges, label) >= 0.85 * modularity(edges, greedy(edges)) - 1e-9
        # no union of two communities is worth anything any more
        together = {v: label[v] for v in label if v != "alone"}
        for a, b in edges:
            if together[a] != together[b]:
                united = {v: together[a] if c == together[b] else c for v, c in together.items()}
                assert modularity(edges, united) <= modularity(edges, together) + 1e-12
