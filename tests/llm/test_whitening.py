"""op12: whitening against numpy's eigenvalues of the exact covariance."""

from fractions import Fraction

import numpy as np
import pytest

from barspark.llm import queries, whitening


def brute(vectors):
    """Distinct x, exact sums, covariance from fractions, eigenvalues and vectors by numpy."""
    x = [tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    off = np.array([[Fraction(a) - Fraction(s, n) for a, s in zip(v, sums)] for v in fit], dtype=object)
    cov = (off.T @ off / n).astype(float)
    values, vecs = np.linalg.eigh(cov)
    return x, n, sums, values[::-1], vecs[:, ::-1].T


def table_of(spark, tmp_path_factory, rows):
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def test_query_equals_numpy(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(300, 9)) * np.array([3, 2, 1.5, 1, .5, .4, .3, .2, .1]) + 40).astype(np.float32)
    good = [(i, [float(c) for c in v], 0) for i, v in enumerate(base)] + [(900 + i, [float(c) for c in base[0]], 1) for i in range(200)]
    bad = [(2000, None, 0), (2001, [float("nan")] * 9, 0), (2002, [None] + [1.0] * 8, 0), (2003, [float("inf")] + [1.0] * 8, 0),
           (2004, [], 0), (2005, [1.0], 0)]
    got = queries.op12_whitening(spark, table_of(spark, tmp_path_factory, good + bad)).collect()
    x, n, sums, values, vecs = brute([v for _, v, _ in good])
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    rows = {k: np.array(v) for (k, _, _), v in zip(good, x)}
    for c in range(4):
        mine = {r.vec_id: r for r in got if r.component == c + 1}
        keys = sorted(mine)
        ours = np.array([mine[k].whitened for k in keys])
        theirs = np.array([(rows[k] - np.array(sums) / n) @ vecs[c] / np.sqrt(values[c]) for k in keys])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-8
        assert mine[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert all(r.deviation == sum((n * a - s) ** 2 for a, s in zip(rows[r.vec_id].tolist(), sums)) for r in got)


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    true = np.array([1e6, 1e3, 1.0, 1e-3, 1e-4, 0.0])
    c = (q * true) @ q.T
    values, vectors = whitening.jacobi(whitening.pivoted_cholesky((c + c.T) / 2))
    assert np.allclose(values[:4], true[:4], rtol=1e-6) and len(values) <= 6
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)


def test_rank_and_empty_tables(spark):
    two = spark.createDataFrame([([1.0, 2.0, 3.0],), ([2.0, 4.0, 3.0],), ([2.0, 4.0, 3.0],), (None,)], "embedding array<double>")
    model = whitening.fit(two)
    assert (model.n, len(model.eigenvalues)) == (2, 1)
    out = whitening.transform(two, model).collect()
    assert sorted(round(abs(r.whitened[0]), 9) for r in out) == [1.0, 1.0, 1.0]
    same = spark.createDataFrame([([1.0, 2.0],)] * 3, "embedding array<double>")
    model = whitening.fit(same)
    assert [r.whitened for r in whitening.transform(same, model).collect()] == [[], [], []]
    empty = spark.createDataFrame([], "embedding array<float>, whitened int")
    assert whitening.transform(empty, whitening.fit(empty)).collect() == []


def test_huge_entries(spark):
    big = spark.createDataFrame([([1e18, 0.5],), ([-1e18, 0.25],), ([3e15, 1.0],)], "embedding array<double>")
    model = whitening.fit(big)
    rows = whitening.transform(big, model).collect()
    assert len(rows) == 3 and {r.deviation for r in rows} == {None} and model.identity_error < 1e-4
    assert model.sums[0] == (2 ** 63 - 1) - 2 ** 63 + 768_000_000_000_000_000


def test_empty_query(spark, tmp_path_factory):
    assert queries.op12_whitening(spark, table_of(spark, tmp_path_factory, [(1, None, 0)])).collect() == []
