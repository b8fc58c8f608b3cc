"""Notebook-dialect indicators and calendar features.

Never mix this frame with the package dialect (T10: ``MACD``/``macd`` collide case-insensitively).
Window columns are grouped by dependency level; unbounded running values (OBV, VPT, streaks)
come from the chunked prefix scan, not from a whole-ticker window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import flag, pct_change, roll_mean, roll_std, roll_sum, safe_div
from barspark.operators.recurrence import ema_halo, with_ema
from barspark.plans import series
from barspark.plans.series import RN
from barspark.session import materialize as _materialize

SQRT_252 = math.sqrt(C.TRADING_DAYS)


def ema_steps() -> list:
    steps = [(f"EMA_{s}", "Close", s) for s in C.NB_EMA]
    steps.append(("MACD_Signal", ("EMA_12", "EMA_26"), 9))
    return steps


def rsi_notebook(gain: str, loss: str, n: int, w: Window) -> Column:
    """Mean gain / mean loss over n rows; loss 0 -> 100 when gains, NULL when flat."""
    g, l_ = roll_mean(gain, n, w), roll_mean(loss, n, w)
    return (F.when(l_ == 0, F.when(g > 0, F.lit(100.0)))
            .otherwise(F.lit(100.0) - safe_div(F.lit(100.0), F.lit(1.0) + safe_div(g, l_))))


def target_class(r: Column) -> Column:
    """Right-closed bins over the fixed edges; NULL stays NULL."""
    e = C.TARGET_CLASS_EDGES
    return (F.when(r.isNull(), None).when(r <= e[0], 0).when(r <= e[1], 1).when(r <= e[2], 2)
            .when(r <= e[3], 3).otherwise(4))


def calendar_notebook(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """F05-F09 on the bar stamp's date."""
    t = F.col(ts)
    return df.withColumns({
        "Day_of_Week": F.weekday(t),
        "Is_Monday": (F.weekday(t) == 0).cast("int"),
        "Is_Friday": (F.weekday(t) == 4).cast("int"),
        "Month": F.month(t),
        "Quarter": F.quarter(t),
        "Day_of_Month": F.dayofmonth(t),
        "Is_Month_Start": (F.dayofmonth(t) <= 5).cast("int"),
        "Is_Month_End": (F.dayofmonth(t) >= 25).cast("int"),
        "Week_of_Year": F.weekofyear(t),
        "Is_January": (F.month(t) == 1).cast("int"),
        "Is_December": (F.month(t) == 12).cast("int"),
        "Days_Since_Year_Start": F.dayofyear(t) - 1,
    })


def date_parts(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Year, Month, Month_Name, DayOfWeek_Name."""
    t = F.col(ts)
    return df.withColumns({"Year": F.year(t), "Month": F.month(t), "Month_Name": F.date_format(t, "MMMM"),
                           "DayOfWeek_Name": F.date_format(t, "EEEE")})


def notebook_features(bars: DataFrame, drop_nulls: bool = True, materialize: bool = True) -> DataFrame:
    """G05-G35 + F05-F09 per ticker, then B18 (drop rows with NULL in non-target columns)."""
    steps = ema_steps()
    halo = max(ema_halo(steps), max(C.NB_SMA), 2 + max(C.NB_VOL_WINDOWS), 2 + max(C.NB_ATR))

    def build(d: DataFrame, w: Window) -> DataFrame:
        d = with_ema(d, steps)
        close, vol = F.col("Close"), F.col("Volume")
        prev = F.lag("Close").over(w)
        a = {"Return": pct_change("Close", 1, w), "_delta": close - prev, "_prev_close": prev,
             "Target_Return": safe_div(F.lead("Close", 1).over(w), close) - F.lit(1.0)}
        for k in C.NB_LAGS:
            a[f"Price_Lag_{k}"] = F.lag("Close", k).over(w)
            a[f"Volume_Lag_{k}"] = F.lag("Volume", k).over(w)
        a["Price_Change_1d"] = close - F.lag("Close", 1).over(w)
        a["Price_Change_5d"] = close - F.lag("Close", 5).over(w)
        for n in C.NB_SMA:
            a[f"SMA_{n}"] = roll_mean("Close", n, w)
        a["BB_Middle"] = roll_mean("Close", C.NB_BB_WINDOW, w)
        a["BB_Std"] = roll_std("Close", C.NB_BB_WINDOW, w)
        a["Volume_Change"] = pct_change("Volume", 1, w)
        a["Volume_Change_5d"] = pct_change("Volume", 5, w)
        for n in C.NB_VOLUME_MA:
            a[f"Volume_MA_{n}"] = roll_mean("Volume", n, w)
        a["Typical_Price"] = (F.col("High") + F.col("Low") + close) / 3
        a["_tpv"] = a["Typical_Price"] * vol
        for n in C.NB_ROC:
            a[f"ROC_{n}"] = safe_div(close - F.lag("Close", n).over(w), F.lag("Close", n).over(w)) * 100
        a[f"Momentum_{C.NB_MOMENTUM}"] = close - F.lag("Close", C.NB_MOMENTUM).over(w)
        a["Gap"] = F.col("Open") - prev
        a["Price_Direction"] = F.signum(close - prev)
        d = d.withColumns(a)

        delta = F.col("_delta")
        pc = F.col("_prev_close")
        b = {"_gain": F.coalesce(F.when(delta > 0, delta), F.lit(0.0)),
             "_loss": F.coalesce(F.when(delta < 0, -delta), F.lit(0.0)),
             "_tr": F.greatest(F.col("High") - F.col("Low"), F.abs(F.col("High") - pc), F.abs(F.col("Low") - pc)),
             "VWAP_20": safe_div(roll_sum("_tpv", C.NB_VWAP_WINDOW, w), roll_sum("Volume", C.NB_VWAP_WINDOW, w)),
             "_macd_prev": F.lag(F.col("EMA_12") - F.col("EMA_26")).over(w),
             "_sig_prev": F.lag("MACD_Signal").over(w),
             "_dir_change": F.coalesce(F.col("Price_Direction") != F.lag("Price_Direction").over(w), F.lit(True))}
        for k in C.NB_LAGS:
            b[f"Return_Lag_{k}"] = F.lag("Return", k).over(w)
        for n in C.NB_VOL_WINDOWS:
            b[f"Volatility_{n}d"] = roll_std("Return", n, w)
        d = d.withColumns(b)

        c = {"Volatility_Change": pct_change("Volatility_20d", 1, w)}
        for n in C.NB_RSI:
            c[f"RSI_{n}"] = rsi_notebook("_gain", "_loss", n, w)
        for n in C.NB_ATR:
            c[f"ATR_{n}"] = roll_mean("_tr", n, w)
        return d.withColumns(c)

    out = series.run_ordered(bars.drop("_seq"), build, halo=halo, ahead=1, keep_index=True)
    out = series.prefix_scan(out, {
        "OBV": ("sum", F.coalesce(F.signum(F.col("Close") - F.col("_prev_close")) * F.col("Volume"), F.lit(0.0))),
        "VPT": ("sum", F.col("Volume") * F.col("Return")),
        "_run_start": ("runmax", F.when(F.col("_dir_change"), F.col(RN))),
    })
    close = F.col("Close")
    p = {}
    for n in C.NB_SMA:
        p[f"Price_to_SMA_{n}"] = safe_div(close, F.col(f"SMA_{n}")) - 1
    for n in C.NB_EMA:
        p[f"Price_to_EMA_{n}"] = safe_div(close, F.col(f"EMA_{n}")) - 1
    p["SMA_Cross_50_200"] = flag(F.col("SMA_50") > F.col("SMA_200"))
    p["EMA_Cross_12_26"] = flag(F.col("EMA_12") > F.col("EMA_26"))
    for n in C.NB_RSI:
        p[f"RSI_{n}_Oversold"] = flag(F.col(f"RSI_{n}") < C.NB_RSI_LOW)
        p[f"RSI_{n}_Overbought"] = flag(F.col(f"RSI_{n}") > C.NB_RSI_HIGH)
    macd = F.col("EMA_12") - F.col("EMA_26")
    p["MACD"] = macd
    p["MACD_Histogram"] = macd - F.col("MACD_Signal")
    p["MACD_Bullish"] = flag(macd > F.col("MACD_Signal"))
    p["MACD_Crossover"] = flag((macd > F.col("MACD_Signal")) & (F.col("_macd_prev") <= F.col("_sig_prev")))
    up = F.col("BB_Middle") + 2 * F.col("BB_Std")
    lo = F.col("BB_Middle") - 2 * F.col("BB_Std")
    p["BB_Upper"], p["BB_Lower"] = up, lo
    p["BB_Width"] = safe_div(up - lo, F.col("BB_Middle"))
    p["BB_Position"] = safe_div(close - lo, up - lo)
    p["BB_Above_Upper"] = flag(close > up)
    p["BB_Below_Lower"] = flag(close < lo)
    for n in C.NB_ATR:
        p[f"ATR_{n}_Pct"] = safe_div(F.col(f"ATR_{n}"), close) * 100
    for n in C.NB_VOL_WINDOWS:
        p[f"Volatility_{n}d_Ann"] = F.col(f"Volatility_{n}d") * F.lit(SQRT_252)
    p["Realized_Vol"] = safe_div(F.col("High") - F.col("Low"), close)
    p["Parkinson_Vol"] = F.sqrt(F.lit(1.0 / (4.0 * math.log(2.0))) * F.pow(F.log(safe_div(F.col("High"), F.col("Low"))), 2))
    for n in C.NB_VOLUME_MA:
        p[f"Volume_Ratio_{n}"] = safe_div(F.col("Volume"), F.col(f"Volume_MA_{n}"))
    p["Price_to_VWAP"] = safe_div(close, F.col("VWAP_20")) - 1
    p["High_Low_Range"] = F.col("High") - F.col("Low")
    p["High_Low_Range_Pct"] = safe_div(F.col("High") - F.col("Low"), close) * 100
    p["Body_Size"] = F.abs(close - F.col("Open"))
    p["Body_Size_Pct"] = safe_div(F.abs(close - F.col("Open")), close) * 100
    p["Upper_Shadow"] = F.col("High") - F.greatest(F.col("Open"), close)
    p["Lower_Shadow"] = F.least(F.col("Open"), close) - F.col("Low")
    p["Is_Bullish"] = flag(close > F.col("Open"))
    p["Gap_Pct"] = safe_div(F.col("Gap"), F.col("_prev_close")) * 100
    p["Consecutive_Up"] = F.when(F.col("Price_Direction").isNotNull(),
                                 F.col("Price_Direction") * (F.col(RN) - F.col("_run_start") + 1))
    p["Target_Direction"] = flag(F.col("Target_Return") > 0)
    p["Target_Class"] = target_class(F.col("Target_Return"))
    out = out.withColumns(p)
    out = calendar_notebook(out)
    out = out.select(*[c for c in NOTEBOOK_COLUMNS])
    if drop_nulls:
        out = out.na.drop(subset=[c for c in out.columns if "Target" not in c])
    return _materialize(out) if materialize else out


def _column_order() -> list[str]:
    cols = ["Timestamp", "Ticker", "Open", "High", "Low", "Close", "Volume", "Return"]
    for k in C.NB_LAGS:
        cols += [f"Price_Lag_{k}", f"Return_Lag_{k}", f"Volume_Lag_{k}"]
    cols += ["Price_Change_1d", "Price_Change_5d"]
    for n in C.NB_SMA:
        cols += [f"SMA_{n}", f"Price_to_SMA_{n}"]
    for n in C.NB_EMA:
        cols += [f"EMA_{n}", f"Price_to_EMA_{n}"]
    cols += ["SMA_Cross_50_200", "EMA_Cross_12_26"]
    for n in C.NB_RSI:
        cols += [f"RSI_{n}", f"RSI_{n}_Oversold", f"RSI_{n}_Overbought"]
    cols += ["MACD", "MACD_Signal", "MACD_Histogram", "MACD_Bullish", "MACD_Crossover",
             "BB_Middle", "BB_Std", "BB_Upper", "BB_Lower", "BB_Width", "BB_Position", "BB_Above_Upper",
             "BB_Below_Lower"]
    for n in C.NB_ATR:
        cols += [f"ATR_{n}", f"ATR_{n}_Pct"]
    for n in C.NB_VOL_WINDOWS:
        cols += [f"Volatility_{n}d", f"Volatility_{n}d_Ann"]
    cols += ["Realized_Vol", "Parkinson_Vol", "Volatility_Change", "Volume_Change", "Volume_Change_5d"]
    for n in C.NB_VOLUME_MA:
        cols += [f"Volume_MA_{n}", f"Volume_Ratio_{n}"]
    cols += ["Typical_Price", "VWAP_20", "Price_to_VWAP", "OBV", "VPT",
             "Day_of_Week", "Is_Monday", "Is_Friday", "Month", "Quarter", "Day_of_Month", "Is_Month_Start",
             "Is_Month_End", "Week_of_Year", "Is_January", "Is_December", "Days_Since_Year_Start"]
    cols += [f"ROC_{n}" for n in C.NB_ROC]
    cols += [f"Momentum_{C.NB_MOMENTUM}", "High_Low_Range", "High_Low_Range_Pct", "Body_Size", "Body_Size_Pct",
             "Upper_Shadow", "Lower_Shadow", "Is_Bullish", "Gap", "Gap_Pct", "Price_Direction", "Consecutive_Up",
             "Target_Return", "Target_Direction", "Target_Class"]
    return cols


NOTEBOOK_COLUMNS = _column_order()
INT_COLUMNS = {"SMA_Cross_50_200", "EMA_Cross_12_26", "RSI_14_Oversold", "RSI_14_Overbought", "RSI_21_Oversold",
               "RSI_21_Overbought", "MACD_Bullish", "MACD_Crossover", "BB_Above_Upper", "BB_Below_Lower",
               "Day_of_Week", "Is_Monday", "Is_Friday", "Month", "Quarter", "Day_of_Month", "Is_Month_Start",
               "Is_Month_End", "Week_of_Year", "Is_January", "Is_December", "Days_Since_Year_Start", "Is_Bullish",
               "Target_Direction", "Target_Class"}
