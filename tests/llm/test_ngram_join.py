import random
from fractions import Fraction

import numpy as np
import pytest

from buildlore.llm import groups as G
from buildlore.llm import ngram_join as J


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def brute(rows):
    """{id: (class, links)} by comparing all pairs."""
    sets = {i: shingles(t or "") for i, t in rows if i is not None}
    link = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                link[a].add(b)
                link[b].add(a)
    out = {}
    for i in sets:
        seen, edge = {i}, [i]
        while edge:
            edge = [y for x in edge for y in link[x] if y not in seen and not seen.add(y)]
        out[i] = (min(seen), len(link[i]))
    return out


def corpus(seed, bases=12, copies=10):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(30))
    rows, n = [], 0
    for _ in range(bases):
        base = [word() for _ in range(rng.choice([3, 8, 60, 200]))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = word()
            rows.append((n, (passage + "\n" if rng.random() < 0.5 else "") + " ".join(w)))
            n += 1
    return rows


def got(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(documents, seed):
    rows = corpus(seed)
    assert got(J.join(documents(rows, extra=True))) == brute(rows)


def test_splitting_and_blocks_find_the_same(documents, monkeypatch):
    rows = corpus(3, 6, 40)
    monkeypatch.setattr(J, "SMALL", 4)
    monkeypatch.setattr(G, "BLOCK", 8)
    assert got(J.join(documents(rows))) == brute(rows)


def test_nulls_empty_repeated_and_no_rows(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (5, "A  b"), (6, "x " * 50_000), (7, "x " * 50_000), (None, "a b")]
    out = got(J.join(documents(rows)))
    assert out == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 1), 7: (6, 1)}
    assert got(J.join(documents([]))) == {}
    kept = J.one_of_each(documents(rows, extra=True))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]


def test_a_key_of_several_texts_connects_all_of_them(documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (2, a), (3, b), (4, c), (5, c + " more"), (5, "one two"), (6, "one two"), (7, ""), (7, c)]
    out = got(J.join(documents(rows)))
    assert {k: v[0] for k, v in out.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}
    assert out[1][1] == out[3][1] == 1 and out[4][1] == 2 and out[6][1] == 1
    assert sorted((r.doc_id, r.text) for r in J.one_of_each(documents(rows)).collect()) == [(1, a), (4, c)]


def test_one_of_each_keeps_the_first_of_each_class(documents):
    rows = corpus(5)
    classes = brute(rows)
    assert {r.doc_id for r in J.one_of_each(documents(rows, extra=True)).collect()} == {k for k, (c, _) in classes.items() if c == k}


def test_runs_follow_the_recall():
    assert 0.06 < J.lost_in_a_run() < 0.07
    assert J.runs_for(0.9) == 1 and J.runs_for(0.999) == 3 and J.runs_for(J.RECALL) == 4


def test_pairs_of_several_groups_count_once():
    sets = [np.array([1, 2, 3, 4, 5]), np.array([1, 2, 3, 4, 5]), np.array([9])]
    args = np.array([10, 20, 30]), sets, [np.array([1, 2])] * 3, np.array([1, 3, 1]), np.zeros(3, int), -1, -1, Fraction(4, 5)
    (ids, links), (who, mate) = G._compare(1, *args)
    assert ids.tolist() == [10, 20] and links.tolist() == [3, 1] and (who.tolist(), mate.tolist()) == ([20], [10])
    assert G._compare(2, *args) is None
