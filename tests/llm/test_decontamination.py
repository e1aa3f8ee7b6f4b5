import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from buildlore.llm import decontamination as D

BENCH = "item_id bigint, text string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 8))) for _ in range(n))


def edit(rng, text, n):
    out = list(text)
    for _ in range(n):
        k, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[k] = "z"
        elif kind == 1:
            out.insert(k, "z")
        else:
            del out[k]
    return "".join(out)


def edits_inside(piece, text):
    """Fewest edits of the piece against any part of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(piece, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_pieces_within_the_budget_are_found_and_no_others():
    rng = random.Random(2)
    items = [prose(rng, rng.choice([8, 20, 40])) for _ in range(12)]
    index = D.Index(list(range(12)), [D.normalise([t])[0] for t in items])
    texts = []
    for t in items:
        for n in range(0, 14, 2):
            cut = t[: rng.choice([len(t), 2 * len(t) // 3])]
            texts.append(f"{prose(rng, 10)} {edit(rng, cut, n)} {prose(rng, 10)}")
    got = {(d, i) for d, i, *_ in D.matches(texts, index)}
    want = set()
    for d, t in enumerate(texts):
        plain = "".join(map(chr, D.normalise([t])[0]))
        for i, t2 in enumerate(items):
            own = "".join(map(chr, D.normalise([t2])[0]))
            if any(edits_inside(own[s : s + m], plain) <= D.budget(m) for s, m in index.pieces[i]):
                want.add((d, i))
    assert got == want and len(want) > 20


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", min_size=12, max_size=40), st.integers(0, 3), st.integers(0, 10_000))
def test_banded_alignment_is_the_whole_table_inside_its_band(piece, n, seed):
    rng = random.Random(seed)
    before = prose(rng, 3)
    text = before + edit(rng, piece, n) + prose(rng, 3)
    code = lambda t: np.array([ord(c) for c in t], np.uint32)
    edits, _ = D.aligned(code(piece), code(text), -60, len(text) + 60)
    assert edits == edits_inside(piece, text)


def test_quotes_of_13_words_from_any_word_of_an_item_are_found():
    rng = random.Random(6)
    items = [prose(rng, n) for n in (13, 14, 40, 59)]
    index = D.Index(list(range(4)), [D.normalise([t])[0] for t in items])
    cuts = [(i, " ".join(w[k : k + 13])) for i, w in enumerate(t.split() for t in items) for k in range(len(w) - 12)]
    texts = [f"{prose(rng, 30)} {q} {prose(rng, 30)}" for _, q in cuts]
    assert {(d, i) for d, i, *_ in D.matches(texts, index)} == {(d, i) for d, (i, _) in enumerate(cuts)}


def test_operator(spark, documents):
    rng = random.Random(3)
    items = [(i, prose(rng, 30)) for i in range(5)] + [(5, None), (None, prose(rng, 30)), (6, "too short"), (7, "")]
    held = items[2][1]
    start = "Ünï — "
    rows = [(1, f"{start}{held.upper()}!"), (2, prose(rng, 300)), (3, None), (4, ""), (None, held), (5, held.replace(" ", "\n\n")), (5, held.replace(" ", "\n\n")), (6, prose(rng, 100_000) + " " + held)]
    docs, bench = documents(rows, extra=True), spark.createDataFrame(items, BENCH).selectExpr("*", "1 AS doc_id")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 2), (None, 2), (5, 2), (6, 2)}
    assert got[1, 2].edits == 0 and got[1, 2].pieces == got[1, 2].of_pieces
    assert rows[0][1][got[1, 2].start : got[1, 2].end] == held.upper()
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert D.contaminated(docs, bench.filter("false")).count() == 0 and D.contaminated(docs.filter("false"), bench).count() == 0


def test_items_without_a_q_gram_are_found_as_whole_words(spark, documents):
    items = [(1, "Qi zu"), (2, "é"), (3, "!!"), (4, "ab cd efg"), (5, "x")]
    rows = [(1, "a qi, ZU b"), (2, "aqi zu"), (3, "an é"), (4, "né"), (5, "ab cd efg"), (6, "ab cd efgh"), (7, "qi"), (8, "x"), (9, ""), (10, None), (11, "...x")]
    docs, bench = documents(rows), spark.createDataFrame(items, BENCH)
    got = {(r.doc_id, r.item_id, r.start, r.end) for r in D.contaminated(docs, bench).collect()}
    assert got == {(1, 1, 2, 8), (3, 2, 3, 4), (5, 4, 0, 9), (8, 5, 0, 1), (11, 5, 3, 4)}
    assert sorted(r.doc_id for r in D.clean(docs, bench).collect()) == [2, 4, 6, 7, 9, 10]


def test_alignments_together_are_the_ones_alone():
    rng = random.Random(4)
    pieces = [prose(rng, rng.randint(1, 12))[: rng.randint(1, 60)] for _ in range(60)]
    texts = [prose(rng, 2) + edit(rng, p, min(len(p), rng.randint(0, 5))) + prose(rng, 2) for p in pieces]
    code = lambda t: np.array([ord(c) for c in t], np.uint32)
    low, high = np.array([-rng.randint(1, 9) for _ in pieces]), np.array([rng.randint(1, 20) for _ in pieces])
    most = np.array([rng.randint(0, 6) for _ in pieces])
    edits, ends = D.aligned_all([code(p) for p in pieces], [code(t) for t in texts], low, high, most)
    for k, (p, t) in enumerate(zip(pieces, texts)):
        alone = D.aligned(code(p), code(t), int(low[k]), int(high[k]))
        assert (edits[k], ends[k]) == alone if alone[0] <= most[k] else edits[k] == most[k] + 1


def test_columns_of_any_name_stay(documents, spark):
    docs = documents([(1, "a b c"), (2, "qi")]).selectExpr("*", "true AS _held", "'x' AS _key", "2 AS _text")
    out = D.clean(docs, spark.createDataFrame([(1, "qi")], BENCH)).collect()
    assert [r.asDict() for r in out] == [{"doc_id": 1, "text": "a b c", "_held": True, "_key": "x", "_text": 2}]


def test_blocks_of_the_benchmark_find_the_same(spark, documents, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, 25)) for i in range(20)]
    docs = documents([(i, prose(rng, 20) + " " + t) for i, t in items])
    bench = spark.createDataFrame(items, BENCH)
    whole = D.contaminated(docs, bench).collect()
    monkeypatch.setattr(D, "BLOCK_CHARS", 1000)
    assert len(D.indexes(bench)) > 1
    assert sorted(D.contaminated(docs, bench).collect()) == sorted(whole) and len(whole) == 20


def test_query_against_shared_word_runs(spark):
    """On the tables, documents that share 13 words in a row with an item, looked for one by one."""
    sf = "/root/testdata/sf0.01"
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    runs = lambda t: {tuple(w[k : k + 13]) for w in [split(t)] for k in range(len(w) - 12)}
    known = set().union(*(runs(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()))
    want = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if runs(r.text) & known}
    assert {r.doc_id for r in D.op8_decontamination(spark, sf).collect()} == want
