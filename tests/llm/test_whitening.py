import numpy as np
import pyarrow as pa
import pytest

from buildlore.llm import qd
from buildlore.llm import whitening as W

SF = "/root/testdata/sf0.001"


def plain(rows, most=32):
    """Rows of (vec_id, vector) of one length by eigenvectors of the covariance."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in kept], np.int64)
    n, total = len(x), x.sum(axis=0)
    y = x * n - total
    centred = y / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:most]
    return [i for i, _ in kept], n, (y * y).sum(axis=1), centred @ w[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("seed", range(12))
def test_singular_values_and_vectors(seed):
    draw = np.random.default_rng(seed)
    n = int(draw.integers(1, 40))
    a = draw.standard_normal((int(draw.integers(1, 60)), n)) * 10.0 ** draw.uniform(-3, 3, n)
    if seed % 3 == 1:  # values that agree
        a = np.linalg.qr(draw.standard_normal((60, n)))[0] @ np.diag(draw.integers(1, 4, n)) @ np.linalg.qr(draw.standard_normal((n, n)))[0]
    if seed % 3 == 2 and n > 2:  # and none at all
        a[:, 0], a[:, 1] = 0, a[:, 2]
    values, w = qd.singular(np.linalg.qr(a, mode="r"), n)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert len(values) == np.linalg.matrix_rank(a, tol=1e-13 * want[0] ** 0.5)
    assert np.abs(values - want[: len(values)]).max() <= 1e-12 * want[0]
    assert np.abs(w @ w.T - np.eye(len(w))).max() < 1e-10
    m = a @ w.T
    assert np.abs(m.T @ m - np.diag(values)).max() <= 1e-11 * want[0]


@pytest.mark.parametrize("matrix", [np.zeros((3, 3)), np.eye(5), np.ones((2, 4)), np.array([[2.0]]), np.diag([3.0, 0.0, 1.0])])
def test_plain_matrices(matrix):
    values, w = qd.singular(matrix, 9)
    want = np.sort(np.linalg.svd(matrix, compute_uv=False) ** 2)[::-1]
    assert np.allclose(values, want[want > 1e-20]) and np.allclose(w @ w.T, np.eye(len(w)))


def test_query_against_eigenvectors(spark):
    got = W.op11_whitening(spark, SF).toPandas()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, n, deviation, white, explained = plain(rows)
    assert len(got) == len(ids) * 32 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    got = got.sort_values(["vec_id", "component"])
    order = np.argsort(ids)
    assert got.deviation.to_numpy().reshape(-1, 32)[:, 0].tolist() == deviation[order].tolist()
    assert np.abs(got.explained.to_numpy()[:32] - explained).max() < 1e-12
    mine, want = got.whitened.to_numpy().reshape(-1, 32), white[order]
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine - want * sign).max() < 1e-8


def make(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' AS _key", "1 AS _v", "'y' AS length", "2 AS part")


def test_rows_that_are_left_out_and_ties(spark, monkeypatch):
    draw = np.random.default_rng(3)
    good = [(i, draw.standard_normal(5).tolist()) for i in range(40)] + [(1, [0.5] * 5), (1, [0.5] * 5), (None, [0.25] * 5)]
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [float("nan")] * 5), (94, [float("inf")] + [1.0] * 4), (95, [1e300] * 5)]
    monkeypatch.setattr(W, "BLOCK_NUMBERS", 35)
    monkeypatch.setattr(W, "FAN_NUMBERS", 1)
    vectors = make(spark, good + bad).repartition(7)
    models = W.fit(vectors)
    out = W.whitened(vectors, models).collect()
    assert sorted(r.vec_id or -1 for r in out) == sorted(i or -1 for i, _ in good)
    ids, n, deviation, white, _ = plain(good, 5)
    assert models[5].n == n == 43 and sorted(r.deviation for r in out) == sorted(deviation.tolist())
    assert np.allclose(sorted(abs(r.whitened[0]) for r in out), sorted(np.abs(white[:, 0])))
    assert W.identity_error(vectors, models)[5] < 1e-12


def test_vectors_without_variance_or_of_other_lengths(spark):
    vectors = make(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0]), (4, [3.0]), (5, [2.0, 2.0, 2.0])])
    models = W.fit(vectors)
    assert {k: len(m.variances) for k, m in models.items()} == {1: 1, 2: 0, 3: 0}
    out = {r.vec_id: r for r in W.whitened(vectors, models).collect()}
    assert out[1].whitened == [] and out[1].deviation == 0 and abs(out[3].whitened[0]) == pytest.approx(1.0)


def test_numbers_of_more_than_64_bits():
    x = np.array([[1 << 60, 5], [-(1 << 60), 6]])
    model = W.Model(2, [0, 11], np.eye(2), np.ones(2), 1.0)
    y = W.spread(x, model)
    assert y.tolist() == [[1 << 61, -1], [-(1 << 61), 1]] and W.deviations(y) == [None, None]
    assert W.deviations(np.array([[3037000499, 0], [3037000500, 0], [3, 4]])) == [3037000499**2, None, 25]


def test_empty_table(spark):
    assert W.fit(make(spark, [])) == {} and W.whitened(make(spark, []), {}).collect() == []
    assert list(W.on_grid(pa.array([], pa.list_(pa.float64())))) == []
