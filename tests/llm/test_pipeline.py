"""The pipeline's stages against plain Python on one small corpus, and its shape on the tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as C
from buildlore.llm import byte_bpe, groups, paragraph_dedup

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_lose_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(C.STAGES):
        n = docs.count()
        docs = C.materialize(stage(spark, docs, SF))
        assert docs.count() <= n
        if i < len(C.STAGES) - 1:
            assert docs.columns == columns
    assert docs.count() > 100


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, SF))
    spark.conf.set(C.BATCH_SETTING, "5000")
    digest = lambda df: sorted((r.doc_id, r.n_tokens, hashlib.sha256(bytes(r.ids)).hexdigest(), r.decoded_sha256) for r in df.collect())
    assert digest(C.run(spark, SF)) == digest(docs)
    assert spark.conf.get(C.BATCH_SETTING) == "5000"
    spark.conf.unset(C.BATCH_SETTING)


def test_stages_take_columns_of_any_name_and_repeated_ids(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = ("_score", "score", "_cuts", "_left", "_held", "_key", "_text", "id", "label", "mark", "start", "class", "n")
    docs = base.unionByName(base.limit(5)).selectExpr("*", *[f"'{k}' AS {c}" for k, c in enumerate(extra)])
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {tuple(r[c] for c in extra) for r in out.collect()} == {tuple(map(str, range(len(extra))))}
        docs = out
    assert docs.count() > 20


def test_planted_cases(spark, tmp_path):
    """Near copies, benchmark passages and repeated passages go, clean documents come out as they went in."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    docs = [(i, prose(150), "en", "s", 0) for i in range(30)]
    near = docs[3][1].split()
    near[70] = "changed"
    docs.append((100, " ".join(near), "en", "s", 0))
    item, passage = prose(50), prose(70)
    docs += [(101, f"{prose(40)} {item} {prose(40)}", "en", "s", 0)]
    docs += [(k, f"{prose(90)}\n{passage}\n{prose(90)}", "en", "s", 0) for k in (102, 103)]
    docs += [(104, None, "en", "s", None), (105, "", None, None, 0)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, names).selectExpr("doc_id", "text", "lang", "source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in C.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(30), 102, 103, 104, 105}
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(ranks)}, special_tokens={}).encode_ordinary
    first, _, last = docs[33][1].split("\n")
    text = {d[0]: d[1] or "" for d in docs} | {103: f"{first}\n{last}"}
    for k, r in out.items():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == encode(text[k])
        assert r.decoded_sha256 == hashlib.sha256(text[k].encode()).hexdigest()


def _python_feeds_python(node, above=False):
    """Whether a task of the plan hands rows from one Python worker to another."""
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.initialPlan()
    python = "InArrow" in node.nodeName()
    if python and above:
        return True
    above = "Exchange" not in node.nodeName() and (above or python)
    children = node.children()
    return any(_python_feeds_python(children.apply(i), above) for i in range(children.size()))


def test_a_task_of_the_dedup_stages_needs_one_python_worker(spark, monkeypatch):
    """Each worker more stays with its executor for the rest of the session."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert _python_feeds_python(docs.mapInArrow(lambda b: b, docs.schema).mapInArrow(lambda b: b, docs.schema)._jdf.queryExecution().executedPlan())
    written, write = [], groups.write_table

    def seen(df, **options):
        written.append(_python_feeds_python(df._jdf.queryExecution().executedPlan()))
        return write(df, **options)

    monkeypatch.setattr(groups, "write_table", seen)
    monkeypatch.setattr(paragraph_dedup, "write_table", seen)
    for stage in (C.drop_near_copies, C.cut_repeats):
        docs = C.materialize(stage(spark, docs, SF))
    assert len(written) > 20 and not any(written)


def test_lines_of_wanted_texts_are_the_same_by_filter_and_by_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "text AS _text")
    ids = docs.select("id").filter("id % 7 = 0").distinct()
    lines = lambda: {tuple(r) for r in paragraph_dedup.line_texts(docs, ids).collect()}
    found, every = lines(), {tuple(r) for r in paragraph_dedup.line_texts(docs, docs.select("id").distinct()).collect()}
    monkeypatch.setattr(groups, "FILTER_BITS", 1)
    joined = lines()
    assert joined and joined <= found < every
