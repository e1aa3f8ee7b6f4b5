"""The trained operators by held-out accuracy, and their odd inputs."""

import numpy as np

from buildlore.llm import language as L
from buildlore.llm import linear
from buildlore.llm import quality as Q
from buildlore.llm import trees

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    out = Q.op7_quality(spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_learns_from_text_outside_the_held_out_fifth_only(spark, documents):
    docs = documents([(i, "good words here" if i % 2 else "bad!! bad!!") for i in range(200)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality", "0 AS toxic")
    one = Q.fit(docs, labels)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) AS quality")
    two = Q.fit(docs, turned)
    assert (one.weights == two.weights).all() and one.bias == two.bias
    scored = {r.doc_id: r.score for r in Q.with_score(docs, one).collect()}
    assert min(v for k, v in scored.items() if k % 2) > 0.5 > max(v for k, v in scored.items() if not k % 2)


def test_quality_odd_inputs(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "x y"), (3, "a " * 600_000), (3, "a " * 600_000)])
    none = Q.fit(docs, spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id bigint, quality int, toxic int"))
    assert {r.score for r in Q.with_score(docs, none).collect()} == {0.5}
    assert Q.with_score(documents([], extra=True).drop("score"), none).count() == 0
    assert Q.with_score(docs, none, "_s").columns == ["doc_id", "text", "_s"]


def test_language_on_held_out_documents(spark):
    rows = L.op9_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_inputs(spark):
    rows = [(i, ["the cat and the dog", "der hund und die katze"][i % 2] * 5, ["en", "de"][i % 2]) for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !!", "de"), (None, "und die katze", "de"), (103, "the dog " * 300_000, None), (104, "ジョジョ", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS _n", "'q' AS label", "'w' AS source")
    model = L.fit(docs.select("doc_id", "text", "lang", "source"))
    got = {r.doc_id: r for r in L.predict(docs, model).collect()}
    assert [got[k].lang_pred for k in (0, 1, None, 103)] == ["en", "de", "de", "en"]
    assert [(got[k].lang_pred, got[k].score) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[104].lang_pred in ("en", "de") and got[104].rejected
    empty = L.fit(docs.select("doc_id", "text", "lang").filter("false"))
    assert {r.lang_pred for r in L.predict(docs, empty).collect()} == {"und"}
    assert L.predict(docs.filter("false"), model).count() == 0


def test_features_do_not_cross_texts():
    import pyarrow as pa

    alone = linear.counts(pa.array(["ab ab", None, "cd"]), 64, (2, 3), True, False)
    for i, t in enumerate(["ab ab", "", "cd"]):
        (at, n), = linear.counts(pa.array([t]), 64, (2, 3), True, False)
        assert (at == alone[i][0]).all() and (n == alone[i][1]).all()


def test_trees_learn_a_rule_of_two_features():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = np.where(x[:, 1] > 0.3, np.where(x[:, 3] > 0, 0, 1), 2)
    forest = trees.fit(x[:2000], y[:2000], 3)
    assert (forest.log_likelihood(x[2000:]).argmax(axis=1) == y[2000:]).mean() > 0.97
