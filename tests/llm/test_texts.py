import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from buildlore.llm import texts as T

WORDS = st.text("ab \n\té.", max_size=40)


def hashed(texts):
    data, at = T.utf8(pa.array(texts, pa.string()))
    return T.words(data, at)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), WORDS), max_size=6))
def test_words_are_those_between_white_space(texts):
    h, doc, starts, ends = hashed(texts)
    data = "".join(t or "" for t in texts).encode()
    want = [(i, w) for i, t in enumerate(texts) for w in (t or "").split()]
    assert [(int(d), data[s:e].decode()) for d, s, e in zip(doc, starts, ends)] == want
    names = {}
    for value, (_, w) in zip(h, want):
        assert names.setdefault(w, value) == value
    assert len(set(names.values())) == len(names)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), WORDS), max_size=6))
def test_shingles_name_five_words_or_all_of_a_short_text(texts):
    h, doc, _, _ = hashed(texts)
    got, who = T.shingles(h, doc, 5)
    want = []
    for i, t in enumerate(texts):
        w = (t or "").split()
        want += [(i, tuple(w[k : k + 5])) for k in range(len(w) - 4)] if len(w) >= 5 else [(i, tuple(w))] * bool(w)
    assert [int(d) for d in who] == [i for i, _ in want]
    names = {}
    for value, (_, w) in zip(got, want):
        assert names.setdefault(w, value) == value
    assert len(set(names.values())) == len(names)


def test_slices_of_sliced_and_long_columns():
    column = pa.array(["x" * 10, None, "y" * 3_000_000, "", "z"])[1:]
    assert [j - i for i, j in T.slices(column, 100)] == [1, 1, 2]
    h, doc, _, _ = T.words(*T.utf8(column))
    assert doc.tolist() == [1, 3]
    assert list(T.slices(pa.array([], pa.string()))) == []


def test_minhash_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    tokens = T.mix(rng.integers(0, 1 << 60, 1200).astype(np.uint64))
    h, doc = np.r_[tokens[:1000], tokens[200:]], np.repeat([0, 1], 1000)
    a, b = T.minhash(h, doc, 2, 2000)
    assert abs((a == b).mean() - 800 / 1200) < 0.04
