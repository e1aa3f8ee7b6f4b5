import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from buildlore.llm import token_alignment as A
from buildlore.llm.byte_bpe import byte_characters

PATHS = public_tokenizers.path(A.FIRST), public_tokenizers.path(A.SECOND)
rising = st.lists(st.integers(1, 60), min_size=1, max_size=40, unique=True).map(sorted)
TEXTS = [
    "The cat sat on the mat.", "the cat", "  two  spaces ", "tab\tand\nline", "", None, "naïve café 日本語 ok", "don't <|endoftext|> </s> <0x41> ▁x",
    "The cat sat on the mat.", "a" * 3000, "word " * 2000, "😀 grin", " ", "x",
]


@settings(max_examples=400, deadline=None)
@given(rising, rising)
def test_gallop_counts_smaller_values(short, long):
    assert A.gallop(np.array(short), np.array(long)).tolist() == [sum(v < x for v in long) for x in short]


@settings(max_examples=300, deadline=None)
@given(rising, rising)
def test_groups_and_overlaps(one, two):
    end = max(one[-1], two[-1]) + 1
    ends = [np.array([*v, end]) for v in (one, two)]
    found = A.align(*ends)
    common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    assert ends[0][found.stops_a - 1].tolist() == ends[1][found.stops_b - 1].tolist() == common
    ranges = [list(zip([0, *e[:-1].tolist()], e.tolist())) for e in ends]
    want = {(i, j) for i, (a, b) in enumerate(ranges[0]) for j, (c, d) in enumerate(ranges[1]) if a < d and c < b}
    got = list(zip(*(x.tolist() for x in found.pairs())))
    assert len(got) == len(set(got)) and set(got) == want


def brute(texts):
    """Each text's figures by other libraries and plain loops."""
    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_characters())}
    with open(PATHS[0], encoding="utf-8") as f:
        spelled = {i: bytes(back[c] for c in p) for p, i in json.load(f)["model"]["vocab"].items()}
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    rows, count = [], Counter()
    for text in texts:
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        told = [spelled[i] for i in a], [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in b)]
        if not text or any(b"".join(t) != b" " + text.encode() for t in told):
            rows.append(None)
            continue
        owner = [[k for k, t in enumerate(side) for _ in t] for side in told]
        ends = [set(np.cumsum([len(t) for t in side]).tolist()) for side in told]
        cuts = sorted(ends[0] & ends[1])
        spell, at = [], 0
        for cut in cuts:
            spell.append("|".join(",".join(str(ids[k]) for k in dict.fromkeys(own[at:cut])) for ids, own in zip((a, b), owner)))
            at = cut
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(*owner))]
        count.update(set(links))
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(spell).encode()).hexdigest()))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [(*r[:3], len(r[3]), sum(count[p] == most[p[0]] for p in r[3]), sum(count[p] for p in r[3]), r[4]) if r else (0, 0, 0, 0, 0, 0, "") for r in rows]


def figures(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()))


def test_against_other_libraries(spark, documents, monkeypatch):
    rows = [(k if k != 3 else None, t) for k, t in enumerate(TEXTS)]
    want = sorted((-1 if k is None else k, *w) for (k, _), w in zip(rows, brute(TEXTS)))
    assert sum(w[1] > 0 for w in want) >= 7
    assert figures(A.alignment_digest(documents(rows, extra=True), *PATHS)) == want
    monkeypatch.setattr(A, "PART_LINKS", 5)  # parts of few texts give the same
    monkeypatch.setattr(A, "ROW_PAIRS", 3)
    assert figures(A.alignment_digest(documents(rows).coalesce(2), *PATHS)) == want


def test_whole_outputs_and_counts(spark, documents):
    rows = [(1, "The cat sat."), (2, ""), (3, "The cat sat."), (4, None)]
    out = {r.doc_id: r for r in A.aligned(documents(rows), *PATHS).collect()}
    assert out[1].a_stops[-1] == len(out[1].a_ids) and out[1].b_stops[-1] == len(out[1].b_ids) and out[2].a_ids == out[4].b_stops == []
    counts = A.link_counts(documents(rows), *PATHS).collect()
    assert {r.documents for r in counts} == {2} and len(counts) == len({(r.a_id, r.b_id) for r in counts})


def test_empty_table(spark, documents):
    assert A.alignment_digest(documents([]), *PATHS).collect() == []
