"""The block-sum EMA against pandas ``ewm(adjust=False)``."""

import numpy as np
import pandas as pd
import pytest

from barspark.operators.recurrence import block_lengths, ema_halo, with_ema
from barspark.plans import series

STEPS = [("e12", "x", 12), ("e26", "x", 26), ("sig", ("e12", "e26"), 9), ("e200", "x", 200), ("e2", "x", 2), ("e1", "x", 1),
         ("v50", "v", 50), ("twice", "e26", 5), ("mixed", ("e12", "v50"), 9)]


def expected(pdf):
    out = pdf.copy()
    for name, src, span in STEPS:
        x = out[src] if isinstance(src, str) else out[src[0]] - out[src[1]]
        out[name] = x.ewm(span=span, adjust=False).mean()
    return out


@pytest.mark.parametrize("rows", [1_000_000, 700])
def test_equals_pandas(spark, rows):
    rng = np.random.default_rng(3)
    frames = []
    for ticker, n in (("A", 5000), ("B", 40), ("C", 1), ("D", 3)):
        x = 100 * np.exp(np.cumsum(rng.normal(0, .02, n)))
        v = rng.integers(1, 10 ** 9, n).astype(float)
        if ticker in ("A", "B"):
            x[rng.random(n) < .05] = np.nan
            x[:3] = np.nan
            v[:11] = np.nan
        if ticker == "A":
            x[1200:1230] = np.nan
        if ticker == "D":
            x[:] = np.nan
        frames.append(pd.DataFrame({"Ticker": ticker, "_rn": range(n), "x": x, "v": v}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    chunked = series.with_halo(df, ema_halo(STEPS), rows)
    out = with_ema(chunked, STEPS).filter("_core")
    assert out.columns == [*chunked.columns, *[s[0] for s in STEPS]]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
    got = out.toPandas().sort_values(["Ticker", "_rn"]).reset_index(drop=True)
    want = pd.concat([expected(f) for f in frames], ignore_index=True)
    for name, _, _ in STEPS:
        np.testing.assert_allclose(got[name].astype(float), want[name], rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=name)


def test_blocks_hold_all_memory_without_underflow():
    for length, spans in block_lengths([2, 5, 9, 12, 26, 50, 200, 2000]):
        for s in spans:
            log = length * -np.log(1 - 2 / (s + 1))
            assert 39 < log < 501
    assert block_lengths([9, 12, 26, 50])[0][1] == [50, 26, 12, 9]
