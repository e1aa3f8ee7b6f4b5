import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from buildlore.llm import suffix_array as A
from buildlore.llm import suffix_dedup as D
from buildlore.session import drop_table


def brute(texts, length):
    """(bytes, removed stretches, kept) of each text, by a count of all windows."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for s in range(len(d) - length + 1):
            if count[d[s : s + length]] > 1:
                gone[s : s + length] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone]))
        out.append((len(d), [tuple(p) for p in edge.reshape(-1, 2).tolist()], bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])))
    return out


def ranked(spark, strings, depth):
    rows = [(t, k, c.encode()) for t, s in enumerate(strings) for k, c in enumerate(s)]
    made = []
    out = {(r.text, r.at): r.rank for r in A.suffix_ranks(spark.createDataFrame(rows, "text bigint, at bigint, word binary"), depth, made).collect()}
    for place in made:
        drop_table(spark, place)
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ranks_are_the_order_of_suffixes(spark, seed, monkeypatch):
    draw = random.Random(seed)
    strings = ["".join(draw.choices("ab" if seed else "abcdefgh", k=draw.randint(1, 40))) for _ in range(12)] + ["a" * 30, "abab" * 8, "b", "abab" * 8]
    monkeypatch.setattr(A, "WIDTH", 7)
    got = ranked(spark, strings, 1000)
    every = sorted(s[k:] for s in strings for k in range(len(s)))
    first = {s: every.index(s) + 1 for s in set(every)}
    assert got == {(t, k): first[s[k:]] for t, s in enumerate(strings) for k in range(len(s))}


def test_ranks_to_a_depth(spark):
    draw = random.Random(5)
    strings = ["".join(draw.choices("ab", k=60)) for _ in range(6)]
    got = sorted((rank, strings[t][k:]) for (t, k), rank in ranked(spark, strings, 4).items())
    assert all(a[1][:4] <= b[1][:4] for a, b in zip(got, got[1:]))
    assert all(a[1][:4] == b[1][:4] for a, b in zip(got, got[1:]) if a[0] == b[0])


def result(df, length):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, [(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in D.without_repeats(df, length).collect())


def made_texts(draw, n):
    phrases = ["".join(draw.choices("abcde ", k=draw.randint(5, 90))) for _ in range(8)]
    texts = ["".join(draw.choice(phrases) if draw.random() < 0.5 else "".join(draw.choices("xyzé", k=draw.randint(0, 30))) for _ in range(draw.randint(0, 9))) for _ in range(n)]
    return texts + [None, "", "ab" * 60, "q" * 90, texts[0], texts[0] + "!", "日本語" * 20, phrases[0][: len(phrases[0]) // 2]]


@pytest.mark.parametrize("length, seed", [(8, 0), (25, 1), (40, 2)])
def test_against_a_count_of_all_windows(spark, documents, length, seed, monkeypatch):
    draw = random.Random(seed)
    texts = made_texts(draw, 40)
    rows = [(k if k != 4 else None, t) for k, t in enumerate(texts)] + [(2, texts[2])]
    monkeypatch.setattr(D, "CHUNK", 64)  # long texts are hashed in parts
    want = sorted((-1 if k is None else k, *w) for (k, _), w in zip(rows, brute([t for _, t in rows], length)))
    assert sum(len(w[2]) for w in want) > 20
    assert result(documents(rows, extra=True).repartition(3), length) == want


def test_passages_at_ends_and_over_many_contexts(spark, documents):
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    passage = " ".join(word() for _ in range(60))
    other = lambda: " ".join(word() for _ in range(30))
    texts = [f"{other()} {passage} {other()}" for _ in range(30)] + [passage, other() + passage, passage[:250] + other(), passage[-199:], other() + passage[100:300], other()]
    rows = list(enumerate(texts))
    assert result(documents(rows), 200) == sorted((k, *w) for k, w in enumerate(brute(texts, 200)))


def test_no_repeats_and_an_empty_table(spark, documents):
    assert result(documents([]), 200) == []
    assert result(documents([(1, "a"), (2, "a"), (3, None)]), 200) == [(1, 1, [], b"a"), (2, 1, [], b"a"), (3, 0, [], b"")]


def test_query_against_a_count_of_all_windows(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (n, sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest()) for r, (n, gone, kept) in zip(rows, brute([r.text for r in rows], 200))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in D.op12_suffix_dedup(spark, sf).collect()}
    assert got == want and any(w[2] for w in want.values())


def test_ranges_of_windows_follow_their_order():
    draw = random.Random(3)
    pairs = [(draw.choice([-9, -1, 0, 4, 7]), draw.randrange(6)) for _ in range(300)]
    for n in (0, 1, 5, 40):
        ends = sorted(draw.choices(pairs, k=n))
        tails, ranks = (np.array([e[k] for e in ends], np.int64) for k in (0, 1))
        got = D._range_of(*(np.array([p[k] for p in pairs], np.int64) for k in (0, 1)), (tails, ranks))
        assert got.tolist() == [sum(e <= p for e in ends) for p in pairs]
