"""Package-dialect indicators and the model feature frame.

All per-ticker window columns of one dependency level are built in one ``select`` so Catalyst
plans them as a single Window node over the shared (Ticker, chunk) partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark import config
from barspark.config import FeatureSettings
from barspark.functions.columns import flag, pct_change, roll_mean, roll_std, safe_div
from barspark.operators.market import local_time
from barspark.operators.recurrence import ema_halo, with_ema
from barspark.plans import series
from barspark.session import materialize as _materialize


def rsi_package(close: str, n: int, w: Window) -> tuple[dict, dict]:
    """E05 in two levels: gains/losses of the n deltas, then 100 - 100/(1+rs); every NULL -> 100."""
    delta = F.col(close) - F.lag(close).over(w)
    lvl1 = {"_gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
            "_loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0)))}
    g, l_ = roll_mean("_gain", n, w), roll_mean("_loss", n, w)
    rs = safe_div(g, F.when(l_ != 0, l_))
    lvl2 = {"rsi": F.coalesce(F.lit(100.0) - safe_div(F.lit(100.0), F.lit(1.0) + rs), F.lit(100.0))}
    return lvl1, lvl2


def calendar_package(df: DataFrame) -> DataFrame:
    """Local hour, weekday (Mon=0) and their cyclic encodings."""
    local = local_time(F.col("Timestamp"), F.col("Ticker"))
    hour, dow = F.hour(local), F.weekday(local)
    two_pi = 2 * math.pi
    return df.withColumns({
        "hour": hour, "day_of_week": dow,
        "hour_sin": F.sin(F.lit(two_pi) * hour / 24), "hour_cos": F.cos(F.lit(two_pi) * hour / 24),
        "day_sin": F.sin(F.lit(two_pi) * dow / 7), "day_cos": F.cos(F.lit(two_pi) * dow / 7),
    })


def package_steps(s: FeatureSettings) -> list:
    return [("ema_fast", "Close", s.ema_fast), ("ema_slow", "Close", s.ema_slow),
            ("macd_signal", ("ema_fast", "ema_slow"), s.macd_signal)]


def feature_frame(bars: DataFrame, s: FeatureSettings = FeatureSettings(), drop_nulls: bool = True,
                  with_targets: bool = True, materialize: bool = True) -> DataFrame:
    """Return, EMAs, MACD, RSI, rolling mean/std, calendar and h-step targets per bar.

    ``drop_nulls`` removes warm-up rows and the last ``horizon`` bars of each ticker (whose
    targets are unknown), as the reference does (T7).
    """
    steps = package_steps(s)
    windows = tuple(s.rolling_windows)
    look_back = max(ema_halo(steps), max(windows) - 1, s.rsi_window + 1)
    ahead = s.horizon if with_targets else 0

    def build(d: DataFrame, w: Window) -> DataFrame:
        d = with_ema(d, steps)
        rsi1, rsi2 = rsi_package("Close", s.rsi_window, w)
        lvl1 = {"return_1": pct_change("Close", 1, w), **rsi1,
                "macd": F.col("ema_fast") - F.col("ema_slow")}
        for n in windows:
            lvl1[f"rolling_mean_{n}"] = roll_mean("Close", n, w)
            lvl1[f"rolling_std_{n}"] = roll_std("Close", n, w)
        if with_targets:
            for h in range(1, s.horizon + 1):
                lvl1[f"target_t{h}"] = F.lead("Close", h).over(w)
        d = d.withColumns(lvl1)
        d = d.withColumns({**rsi2, "macd_hist": F.col("macd") - F.col("macd_signal")})
        return d.drop("_gain", "_loss")

    out = series.run_ordered(bars.drop("_seq"), build, halo=look_back, ahead=ahead)
    out = calendar_package(out)
    cols = ["Timestamp", "Ticker", *config.PACKAGE_FEATURES]
    if with_targets:
        cols += [f"target_t{h}" for h in range(1, s.horizon + 1)]
    out = out.select(*cols)
    out = out.na.drop(how="any") if drop_nulls else out
    return _materialize(out) if materialize else out


def latest_rows(df: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` rows of every ticker."""
    return series.latest_n(df, n)
