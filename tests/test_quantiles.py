"""Distributed selection against numpy on the whole values."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators.quantiles import exact_quantiles, order_key

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def test_order_key_is_the_order_of_doubles(spark):
    rng = np.random.default_rng(0)
    bits = rng.integers(-2 ** 63, 2 ** 63 - 1, 4000)
    values = [v for v in np.frombuffer(bits.tobytes(), dtype=float).tolist() if not math.isnan(v)]
    values += [0.0, 5e-324, -5e-324, 2.0 ** -1022, math.nextafter(2.0 ** -1022, 0), 1.7976931348623157e308, math.inf, -math.inf, 1.0,
               math.nextafter(1.0, 2), math.nextafter(1.0, 0), 8.0, math.nextafter(8.0, 0), 1000.0, 1e22, 2.0 ** 1023, 2.0 ** -1021]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k")).collect()
    for r in got:
        raw = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.k == (raw if r.v >= 0 else -raw), r.v


def frame():
    rng = np.random.default_rng(1)
    hot = pd.DataFrame({"Ticker": "HOT", "a": np.exp(rng.normal(0, 80, 30000)), "b": rng.integers(0, 7, 30000).astype(float)})
    others = [pd.DataFrame({"Ticker": f"T{i}", "a": rng.normal(0, 1, n), "b": np.full(n, -3.5)}) for i, n in enumerate((1, 2, 3, 10, 900, 2400))]
    pdf = pd.concat([hot, *others], ignore_index=True)
    pdf.loc[rng.random(len(pdf)) < .02, "a"] = np.nan
    pdf.loc[pdf.Ticker == "T1", "a"] = np.nan
    return pdf


@pytest.mark.parametrize("few,bits", [(10_000, 11), (50, 11), (0, 8)])
def test_hot_ticker_over_many_tasks(spark, few, bits):
    pdf = frame()
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(16)
    out = exact_quantiles(df, ["Ticker"], {"a": "a", "b": F.col("b") * 2}, PROBS, {"n": F.count("v"), "rows": F.count(F.lit(1))}, few, bits)
    got = {(r.Ticker, r["column"]): r for r in out.collect()}
    assert len(got) == 2 * pdf.Ticker.nunique()
    for ticker, g in pdf.groupby("Ticker"):
        for c, x in (("a", g.a.dropna().to_numpy()), ("b", g.b.to_numpy() * 2)):
            r = got[ticker, c]
            assert (r.n, r.rows) == (len(x), len(g))
            if len(x):
                np.testing.assert_allclose(r.q, np.quantile(x, PROBS), rtol=1e-12)
            else:
                assert r.q == [None] * len(PROBS)


def test_joined_when_there_are_many_intervals(spark, monkeypatch):
    from barspark.operators import quantiles

    monkeypatch.setattr(quantiles, "MOST_BROADCAST", 0)
    pdf = pd.DataFrame({"k": [None, None, "x", "x"] * 50, "v": np.arange(200.0) ** 3})
    out = exact_quantiles(spark.createDataFrame(pdf, "k string, v double"), ["k"], {"v": "v"}, (0.5, 0.33), few=5).collect()
    for r in out:
        x = pdf[pdf.k.isna() if r.k is None else pdf.k == r.k].v
        np.testing.assert_allclose(r.q, np.quantile(x, (0.5, 0.33)), rtol=1e-12)
    assert len(out) == 2


def test_small_groups_are_sorted_without_intervals(spark, monkeypatch):
    """Many small groups need no join of their intervals with all values."""
    from barspark.operators import quantiles

    monkeypatch.setattr(quantiles, "_inside", lambda *a: pytest.fail("values were joined with intervals"))
    rows = [(f"k{i % 300}" if i % 300 else None, None if i % 11 == 0 else float(i * 7919 % 1000)) for i in range(6000)]
    out = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], {"v": "v"}, (0.25, 0.75)).collect()
    assert len(out) == 300
    for r in out:
        np.testing.assert_allclose(r.q, np.quantile([v for k, v in rows if k == r.k and v is not None], (0.25, 0.75)), rtol=1e-12)


def test_empty_table(spark):
    assert exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], {"v": "v"}, (0.5,)).collect() == []
