"""Chunk summaries of a curve compose to the curve of the whole series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.operators import backtest
from barspark.operators import evaluate as ev


def curve(returns):
    """End and worst drawdown by walking the series."""
    value, peak, worst, end = 1.0, None, None, None
    for r in returns:
        if r is None:
            continue
        value *= 1 + r
        peak = value if peak is None else max(peak, value)
        end = value
        if peak != 0:
            fall = (value - peak) / peak
            worst = fall if worst is None else min(worst, fall)
    return end, worst


def cases():
    rng = np.random.default_rng(3)
    out = {f"calm{i}": rng.normal(0, 0.05, 60).tolist() for i in range(3)}
    out |= {f"wild{i}": rng.normal(-0.4, 1.0, int(rng.integers(1, 60))).tolist() for i in range(25)}  # factors below 0
    out |= {"ruined": [0.1, 0.2, -1.0, 0.3, 0.1], "ruined_at_once": [-1.0, 0.5], "below_at_once": [-1.5, 0.2, -0.3, -2.0, 0.5, -0.1],
            "gaps": [None, 0.1, None, -0.3, None, None, 0.2, None], "none": [None, None], "late": [None] * 20 + [0.1, -0.2],
            "ruined_late": [0.5] + [0.0] * 12 + [-1.0] + [0.2] * 12}
    return out


@pytest.mark.parametrize("rows", [1, 4, 7, 1000])
def test_any_cut_gives_the_same_curve(spark, rows):
    data = cases()
    table = [(k, i, r) for k, rs in data.items() for i, r in enumerate(rs)]
    d = spark.createDataFrame(table, "k string, _rn long, r double").withColumn("_chunk", F.floor(F.col("_rn") / rows))
    got = backtest.series_summaries(d, F.col("r"), {"n": F.lit(1.0)}, {"m": F.col("r")}, ["k"]).collect()
    assert len(got) == len(data)
    for g in got:
        rs = data[g.k]
        end, worst = curve(rs)
        known = np.array([r for r in rs if r is not None])
        assert g.n == len(rs) and g.m.n == len(known)
        for a, b in ((g.curve_end, end), (g.drawdown, worst)):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)), g.k
        if len(known):
            assert g.m.mean == pytest.approx(known.mean(), abs=1e-12) and g.m.m2 == pytest.approx(((known - known.mean()) ** 2).sum(), abs=1e-9)


def test_metrics_do_not_depend_on_chunks(spark, tiny_chunks):
    rng = np.random.default_rng(5)
    rows = [(m, t, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(y), float(y + e) if m != "dead" else None)
            for m in ("a", "dead") for t in ("X", "Y") for i, (y, e) in enumerate(zip(rng.lognormal(3, 0.6, 50), rng.normal(0, 3, 50)))]
    preds = spark.createDataFrame(rows, "Model string, Ticker string, Timestamp timestamp, y double, yhat double")
    result = lambda: [sorted(map(tuple, f(preds).collect()), key=str) for f in (ev.validation_metrics, ev.test_metrics)]
    many = result()
    spark.conf.unset("barspark.chunkRows")
    for a, b in zip(many, result()):
        for x, y in zip(a, b):
            assert x[:2] == y[:2]
            for u, v in zip(x[2:], y[2:]):
                assert (u is None) == (v is None) and (u is None or u == pytest.approx(v, rel=1e-8))
    for row in many[1]:
        assert (row[0] == "dead") == all(v is None for v in row[2:])
