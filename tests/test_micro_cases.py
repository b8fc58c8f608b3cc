"""Hand-computed micro-cases (FIXTURES.md §3) and semantic traps."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barspark.operators import cleaning, evaluate, indicators, notebook
from barspark.operators.dataset import split_train_val
from barspark.plans import series


def bars(spark, closes, ticker="T", volume=None, opens=None, highs=None, lows=None):
    t0 = datetime(2024, 1, 1)
    rows = []
    for i, c in enumerate(closes):
        vals = [opens[i] if opens else c, highs[i] if highs else c, lows[i] if lows else c, c,
                volume[i] if volume else 1.0]
        rows.append((t0 + timedelta(days=i), ticker, *[None if v is None else float(v) for v in vals]))
    return spark.createDataFrame(rows, "Timestamp timestamp, Ticker string, Open double, High double, Low double, Close double, Volume double")


def col_values(df, c):
    return [r[c] for r in df.orderBy("Timestamp").collect()]


def approx(xs, ys, tol=1e-6):
    assert len(xs) == len(ys)
    for x, y in zip(xs, ys):
        if y is None:
            assert x is None
        else:
            assert x is not None and abs(x - y) < tol, (xs, ys)


RSI_IN = [1, 2, 1.5, 1.7, 1.2, 1.2, 1.2, 1.2, 1.2, 1.0]


def test_rsi_package_dialect(spark):
    b = bars(spark, RSI_IN)

    def build(d, w):
        l1, l2 = indicators.rsi_package("Close", 3, w)
        return d.withColumns(l1).withColumns(l2)

    out = series.run_ordered(b, build, halo=4)
    approx(col_values(out, "rsi"), [100, 100, 100, 70.588235, 16.666667, 28.571429, 0, 100, 100, 0])


def test_rsi_notebook_dialect(spark):
    b = bars(spark, RSI_IN)

    def build(d, w):
        delta = F.col("Close") - F.lag("Close").over(w)
        d = d.withColumns({"_g": F.coalesce(F.when(delta > 0, delta), F.lit(0.0)),
                           "_l": F.coalesce(F.when(delta < 0, -delta), F.lit(0.0))})
        return d.withColumn("rsi", notebook.rsi_notebook("_g", "_l", 3, w))

    out = series.run_ordered(b, build, halo=4)
    approx(col_values(out, "rsi"), [None, None, 66.666667, 70.588235, 16.666667, 28.571429, 0, None, None, 0])


def test_streak_obv_vpt_and_target_class(spark):
    closes = [10, 11, 12, 11, 11, 11, 10, 9, 12]
    f = notebook.notebook_features(bars(spark, closes), drop_nulls=False, materialize=False)
    approx(col_values(f, "Consecutive_Up"), [None, 1, 2, -1, 0, 0, -1, -2, 1])
    b2 = bars(spark, [10, 11, 10, 10], volume=[5, 6, 7, 8])
    f2 = notebook.notebook_features(b2, drop_nulls=False, materialize=False)
    approx(col_values(f2, "OBV"), [0, 6, -1, -1])
    approx(col_values(f2, "VPT"), [None, 0.6, -0.036364, -0.036364])


def test_target_class_edges(spark):
    vals = [-0.02, -0.0200001, -0.005, 0.005, 0.0051, 0.02, 0.03, None]
    df = spark.createDataFrame([(v,) for v in vals], "r double")
    got = [r[0] for r in df.select(notebook.target_class(F.col("r"))).collect()]
    assert got == [0, 0, 1, 2, 3, 3, 4, None]


def test_true_range(spark):
    """Row max of (H-L, |H-prevC|, |L-prevC|) skipping the missing previous close (pandas max(axis=1))."""
    df = spark.createDataFrame([(5.0, 4.0, None), (6.0, 3.0, 4.5)], "High double, Low double, prev double")
    tr = F.greatest(F.col("High") - F.col("Low"), F.abs(F.col("High") - F.col("prev")), F.abs(F.col("Low") - F.col("prev")))
    assert [r[0] for r in df.select(tr).collect()] == [1.0, 3.0]


@pytest.mark.parametrize("scope,expected", [("ticker", [None, None, 5, 5]), ("global", [5, 5, 5, 5])])
def test_fill_scopes_all_null_ticker(spark, scope, expected):
    rows = [(datetime(2024, 1, 1), "A", None), (datetime(2024, 1, 2), "A", None),
            (datetime(2024, 1, 1), "B", None), (datetime(2024, 1, 2), "B", 5.0)]
    df = spark.createDataFrame(rows, "Timestamp timestamp, Ticker string, Close double")
    out = cleaning.fill_ohlcv(df, scope=scope, cols=("Close",)).orderBy("Ticker", "Timestamp")
    assert [r["Close"] for r in out.collect()] == expected


def test_fill_forward_then_back(spark):
    rows = [(datetime(2024, 1, 1), "A", 1.0), (datetime(2024, 1, 2), "A", None),
            (datetime(2024, 1, 1), "B", None), (datetime(2024, 1, 2), "B", 5.0)]
    df = spark.createDataFrame(rows, "Timestamp timestamp, Ticker string, Close double")
    for scope in ("ticker", "global"):
        out = cleaning.fill_ohlcv(df, scope=scope, cols=("Close",)).orderBy("Ticker", "Timestamp")
        assert [r["Close"] for r in out.collect()] == [1, 1, 5, 5]


@pytest.mark.parametrize("n,expected", [(60, (48, 48, 1, 0)), (80, (64, 48, 17, 0)), (100, (80, 48, 33, 5)),
                                        (200, (160, 112, 113, 41)), (241, (192, 144, 145, 50))])
def test_split_arithmetic(spark, n, expected):
    b = bars(spark, [float(i + 1) for i in range(n)])
    s = split_train_val(b, 0.2, 48).collect()
    cutoff = s[0]["_cutoff"]
    val_start = min(r["_rn"] for r in s if r["is_val"])
    train_rows = sum(r["is_train"] for r in s)
    val_rows = sum(r["is_val"] for r in s)
    assert (cutoff, val_start, max(train_rows - 47, 0), max(val_rows - 47, 0)) == expected


def test_percentile_matches_pandas(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    assert df.select(F.percentile("x", 0.25)).collect()[0][0] == 1.75


def test_ema_span_one_is_identity(spark):
    from barspark.operators.recurrence import with_ema
    b = series.with_halo(series.index_rows(bars(spark, [3.0, 1.0, 4.0, 1.0, 5.0])), 0)
    out = with_ema(b, [("e", "Close", 1)])
    assert col_values(out, "e") == [3.0, 1.0, 4.0, 1.0, 5.0]


def test_ema_matches_recursive_definition(spark, tiny_chunks):
    import random
    random.seed(3)
    xs = [100 + random.gauss(0, 1) for _ in range(60)]
    d = bars(spark, xs)

    def build(df, w):
        from barspark.operators.recurrence import with_ema
        return with_ema(df, [("e", "Close", 5)])

    from barspark.operators.recurrence import ema_halo
    out = series.run_ordered(d, build, halo=ema_halo([("e", "Close", 5)]))
    a = 2 / 6
    y, ref = None, []
    for x in xs:
        y = x if y is None else (1 - a) * y + a * x
        ref.append(y)
    approx(col_values(out, "e"), ref, 1e-9)


def test_sharpe_and_drawdown_flavours(spark):
    rows = [("m", "T", datetime(2024, 1, 1) + timedelta(days=i), float(y), float(p))
            for i, (y, p) in enumerate([(10, 10), (11, 12), (10.5, 11), (12, 13), (12.5, 12)])]
    preds = spark.createDataFrame(rows, "Model string, Ticker string, Timestamp timestamp, y double, yhat double")
    t = evaluate.test_metrics(preds).collect()[0]
    # long/cash: returns when the forecast rises: [0.1, 0, 0.142857, 0]
    import numpy as np
    r = np.array([0.1, 0.0, 1.5 / 10.5, 0.0])
    assert abs(t["Sharpe_Ratio"] - r.mean() / r.std() * np.sqrt(252)) < 1e-9
    cum = np.cumprod(1 + r)
    assert abs(t["Cumulative_Return_pct"] - (cum[-1] - 1) * 100) < 1e-6


def test_failed_model_has_null_metrics(spark):
    from barspark.operators.evaluate import test_metrics as metrics_on_test
    from barspark.operators.evaluate import validation_metrics

    rows = [(m, "T", f"2024-01-{d:02d} 00:00:00", 100.0 + d, None if m == "failed" else 99.0 + d)
            for m in ("failed", "fine") for d in range(1, 9)]
    preds = spark.createDataFrame(rows, "Model string, Ticker string, Timestamp string, y double, yhat double").withColumn(
        "Timestamp", F.to_timestamp("Timestamp"))
    for fn in (metrics_on_test, validation_metrics):
        got = {r.Model: r.asDict() for r in fn(preds).collect()}
        bad = {k for k, v in got["failed"].items() if k not in ("Model", "Ticker") and v is not None}
        assert not bad, bad
        assert got["fine"]["RMSE"] == 1.0
