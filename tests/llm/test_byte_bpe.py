import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from buildlore.llm import byte_bpe as B

PATH = public_tokenizers.path(B.VOCABULARY)
RANKS = B.read_ranks(PATH)
OURS = B.Encoder(B.serialised_model(RANKS), RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(RANKS)}, special_tokens={})


def same(texts):
    for text, packed in zip(texts, OURS.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == THEIRS.encode_ordinary(text)
        assert OURS.decode(packed) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_text_as_the_rank_library_does(texts):
    same(texts)


def test_every_vocabulary_entry_and_hard_texts():
    same([b.decode() for b in RANKS if b.decode("utf-8", "ignore").encode() == b])
    same(["", " ", "\n\n  x\t", "a" * 20_000, "<|endoftext|>", "\x00Ā￿", "é𝄞", "日本語 テキスト", "don't 's 'S 12345", "Ġ Ċ ▁"])


def test_memory_of_tokens_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 10)
    own = B.Encoder(OURS.model.serialized_model_proto(), RANKS, public_tokenizers.PATTERN)
    texts = [f"word{i} and{i} {'x' * 60}{i}" for i in range(50)]
    for t in texts:
        assert own.encode([t]) == OURS.encode([t])
        assert len(own.known) <= 20


def test_operator_and_its_digests(spark, documents):
    rows = [(1, "Hello  wörld"), (2, None), (3, ""), (3, ""), (None, "x"), (5, "many words " * 100_000)]
    got = B.encode(documents(rows, extra=True), PATH)
    out = sorted(got.withColumn("array", B.ids_array(got["ids"])).filter("doc_id is null or doc_id < 5").collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, bytes(r.decoded).decode()) for r in out] == [(None, "x"), (1, "Hello  wörld"), (2, ""), (3, ""), (3, "")]
    assert out[1].array == THEIRS.encode_ordinary("Hello  wörld") and out[1].n_tokens == len(out[1].array)
    long = got.filter("doc_id = 5").collect()[0]
    assert bytes(long.ids) == np.array(THEIRS.encode_ordinary(rows[-1][1]), "<u4").tobytes()
    assert B.encode(documents([]), PATH).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in B.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = np.array(THEIRS.encode_ordinary(docs[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest())
