import random
import re
from collections import Counter, defaultdict

import numpy as np

from buildlore.llm import paragraph_dedup as P


def sentence(rng, n):
    w = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return w[0].capitalize() + " " + " ".join(w[1:]) + "."


def lines_to_go(rows):
    """(id, start) of the whole lines that all-pairs comparison removes."""
    places = defaultdict(list)
    for i, t in rows:
        for m in re.finditer(r"[^\n]+", t):
            if len(m.group().split()) >= P.LEAST_WORDS:
                lead = len(m.group()) - len(m.group().lstrip())
                places[" ".join(m.group().lower().split())].append((i, m.start() + lead))
    keys = list(places)
    sets = []
    for k in keys:
        w = k.split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, k in enumerate(keys):
        groups[find(i)] += places[k]
    return {p for v in groups.values() for p in sorted(v)[1:]}


def test_lines_equal_brute_force(documents):
    rng = random.Random(4)
    pool = [" ".join(sentence(rng, rng.randint(6, 14)) for _ in range(rng.randint(2, 6))) for _ in range(30)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.6:
                w = rng.choice(pool).split()
                for _ in range(rng.randint(0, 2)):
                    w[rng.randrange(len(w))] = "edited"
                parts.append("  " * rng.randint(0, 1) + " ".join(w))
            else:
                parts.append(" ".join(sentence(rng, 9) for _ in range(4)))
        rows.append((i, "\n".join(parts)))
    got = P.repeats(documents(rows, extra=True)).collect()
    want = lines_to_go(rows)
    found = {(r.doc_id, r.start) for r in got}
    assert want <= found
    text = dict(rows)
    for r in got:  # what else goes are repeated passages inside lines
        assert len(text[r.doc_id][r.start : r.end].split()) >= P.LEAST_WORDS
        assert (r.kept_id, r.kept_start) < (r.doc_id, r.start)
        if (r.doc_id, r.start) not in want:
            assert text[r.doc_id][r.start : r.end].lower() in text[r.kept_id].lower()


def test_passage_inside_other_prose_is_found(documents):
    rng = random.Random(7)
    own = lambda: " ".join(sentence(rng, 10) for _ in range(5))
    passages = [" ".join(sentence(rng, 11) for _ in range(9)) for _ in range(20)]
    rows = [(2 * i + k, f"{own()} {p} {own()}") for i, p in enumerate(passages) for k in range(2)] + [(1000 + i, own()) for i in range(20)]
    hit = {r.doc_id for r in P.repeats(documents(rows)).collect()}
    assert hit <= {2 * i + 1 for i in range(20)} and len(hit) == 20


def words_to_go(rows, within):
    """(id, word) of every word in a run of `LEAST_WORDS` words that stands at an earlier place too; runs stay within what `within` splits off."""
    first, gone = {}, set()
    for i, t in sorted(rows):
        n = 0
        for part in within(t):
            w = part.lower().split()
            for k in range(len(w) - P.LEAST_WORDS + 1):
                if first.setdefault(tuple(w[k : k + P.LEAST_WORDS]), (i, n + k)) != (i, n + k):
                    gone |= {(i, n + k + j) for j in range(P.LEAST_WORDS)}
            n += len(w)
    return gone


def words_cut(rows, got):
    """(id, word) of every word that lies in a span."""
    out = set()
    for i, t in rows:
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        out |= {(i, k) for r in got if r.doc_id == i for k, (a, b) in enumerate(at) if r.start <= a and b <= r.end}
    return out


def test_every_word_of_a_repeated_passage_goes(documents):
    """Passages of 20 to 80 words inside lines, of sentences of any length and of none, at any place."""
    rng = random.Random(11)
    plain = lambda n: sentence(rng, n)[:-1].lower()
    rows = []
    for i, n in enumerate([20, 21, 33, 51, 51, 51, 52, 80] * 4):
        size = [10, 15, 20, 99][i // 8]
        w = plain(n).split()
        passage = " ".join(x + "." if k % size == size - 1 else x for k, x in enumerate(w))
        rows += [(3 * i + k, f"{plain(rng.randint(1, 60))} {passage} {plain(rng.randint(1, 60))}") for k in range(3)]
    got = P.repeats(documents(rows)).collect()
    want = words_to_go(rows, lambda t: [t])
    assert words_cut(rows, got) == want and len({i for i, _ in want}) == 64


def test_passages_over_short_lines_go(documents):
    """Passages of over 50 words on lines of 3 to 19 words, whatever the lines around are, and set on other lines elsewhere."""
    rng = random.Random(12)
    short = lambda n: "\n".join(sentence(rng, rng.randint(3, 19)) for _ in range(n))
    rows = []
    for i in range(12):
        w = sentence(rng, 55).split()
        for k in range(3):
            step = rng.randint(3, 19)
            passage = "\n\n".join(" ".join(w[j : j + step]) for j in range(0, 55, step))
            rows.append((3 * i + k, f"{short(rng.randint(1, 4))}\n{passage}\n{short(2)}"))
    got = P.repeats(documents(rows)).collect()
    want = words_to_go(rows, lambda t: [t])
    assert words_cut(rows, got) == want and len({i for i, _ in want}) == 24


def test_fewest_ranges_hold_the_same():
    rng = random.Random(3)
    for _ in range(300):
        ranges = [(rng.randrange(3), a, a + rng.randint(1, 9)) for a in (rng.randrange(30) for _ in range(rng.randint(0, 14)))]
        text, start, stop = (np.array([r[k] for r in ranges], np.int64) for k in range(3))
        held = lambda some: {(t, x) for t, a, b in some for x in range(a, b)}
        picked = [ranges[k] for k in P.fewest(text, start, stop)]
        assert held(picked) == held(ranges) and len(set(picked)) == len(picked)
        # of any three neighbours the first and the last do not touch, or the middle one would not be needed
        picked.sort()
        assert all(a[0] != c[0] or a[2] < c[1] for a, c in zip(picked, picked[2:]))


def test_cutting(spark):
    docs = spark.createDataFrame([(1, "éa\nbb\ncc", 8, "x"), (2, None, 0, None), (None, "q", 1, "y"), (3, "all", 3, "z")], "doc_id bigint, text string, n_chars bigint, start string")
    spans = spark.createDataFrame([(1, 3, 5), (1, 4, 5), (3, 0, 3)], "doc_id bigint, start int, end int")
    out = P.without(docs, spans)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, "éa\ncc", 5), (2, None, None), (None, "q", 1), (3, "", 0)}


def test_cutting_leaves_blank_lines_and_other_texts_alone(spark):
    rows = [(1, "p one\n\np two\n\n \np three", 1), (2, "gone\n\nkeep \ue000 this text\n\nend", 2), (2, "another text of the key", 3), (4, "a b\nc d\ne f", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _cuts int").selectExpr("*", "'l' AS _left", "'m' AS mark", "5 AS start", "6 AS _of", "7 AS _mark")
    marks = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    spans = [(1, 7, 12, marks[rows[0][1]]), (2, 0, 4, marks[rows[1][1]]), (4, 2, 6, marks[rows[3][1]])]
    out = P.without(docs, spark.createDataFrame(spans, "doc_id bigint, start int, end int, mark bigint"))
    assert out.columns == docs.columns
    assert sorted((r._cuts, r.text) for r in out.collect()) == [(1, "p one\n\n\n \np three"), (2, "\nkeep \ue000 this text\n\nend"), (3, "another text of the key"), (4, "a d\ne f")]


def test_a_key_of_several_texts(documents):
    line, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, f"{line}\nend"), (1, f"start\n{line}\n{other}"), (2, f"{other}\n{third}"), (3, "clean words " * 3)]
    docs = documents(rows)
    cut = P.without(docs, P.repeats(docs, marks=True)).collect()
    texts = " ".join(r.text for r in cut)
    assert len(cut) == 4 and all(texts.count(t) == 1 for t in (line, other, third)) and "clean words" in texts and "start" in texts and "end" in texts


def test_nulls_empty_repeated_long_and_no_rows(documents):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, line), (3, line), (4, line.upper()), (None, line), (5, (line + "\n") * 3), (6, "z" * 2_000_000)]
    got = {(r.doc_id, r.start, r.kept_id, r.kept_start) for r in P.repeats(documents(rows)).collect()}
    n = len(line) + 1
    assert got == {(4, 0, 3, 0)} | {(5, k * n, 3, 0) for k in range(3)}
    assert P.repeats(documents([])).count() == 0


def test_bands_follow_the_recall():
    assert 1 - (1 - 0.8**P.ROWS) ** P.BANDS >= P.RECALL
    assert Counter([P.bands_for(0.5)])[1] == 1
