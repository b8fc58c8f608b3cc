"""Stacking of any number of base models against numpy, and on rows it wasn't fitted on."""

import numpy as np
import pytest

from barspark.operators import models


def tables(spark, p, seed=5):
    rng = np.random.default_rng(seed)
    rows, by_key = [], {}
    for key, n in (("A", 60), ("B", 25), ("ONE", 1)):
        x = rng.normal(size=(n, p)) * 10 + 100
        y = x @ rng.normal(size=p) + 7 + rng.normal(size=n)
        by_key[key] = x, y
        rows += [(key, *map(float, a), float(b)) for a, b in zip(x, y)]
    names = [f"m{i}" for i in range(p)]
    df = spark.createDataFrame(rows, "Ticker string, " + ", ".join(f"{m} double" for m in names) + ", y double")
    return df.repartition(4), names, by_key


@pytest.mark.parametrize("p", [1, 2, 3, 6])
def test_ridge_equals_numpy(spark, p):
    df, names, by_key = tables(spark, p)
    weights = models.fit_stacking(df, names, "y", 0.5)
    got = {r.Ticker: r for r in weights.collect()}
    for key, (x, y) in by_key.items():
        c = x - x.mean(0)
        w = np.linalg.solve(c.T @ c + 0.5 * np.eye(p), c.T @ (y - y.mean()))
        assert np.allclose([got[key][f"w_{m}"] for m in names], w, rtol=1e-8, atol=1e-10)
        assert np.isclose(got[key].intercept, y.mean() - w @ x.mean(0))
    scored = models.apply_stacking(df, weights, names).where("Ticker = 'A'")
    assert scored.columns == [*df.columns, "stacked"]
    for r in scored.collect():
        assert np.isclose(r.stacked, got["A"].intercept + sum(got["A"][f"w_{m}"] * r[m] for m in names))


def test_singular_without_penalty_is_null(spark):
    df = spark.createDataFrame([("A", float(i), 1.0, float(i)) for i in range(5)], "Ticker string, m0 double, m1 double, y double")
    r = models.fit_stacking(df, ["m0", "m1"], "y", 0.0).first()
    assert r.w_m1 is None and r.intercept is None
