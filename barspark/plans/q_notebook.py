"""Notebook-dialect feature queries (G rows, F04-F09)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import output
from barspark.operators import cleaning, notebook
from barspark.plans import sql as S
from barspark.plans.registry import query
from barspark.sources import fixtures as fx

W = 'Ticker ORDER BY "Timestamp"'


def _lag(x, k=1):
    return f"lag({x}, {k}) OVER (PARTITION BY {W})"


def _pct(x, k=1):
    return f"({S.div(x, _lag(x, k))} - 1)"


def nb_source_sql(view: str = "daily") -> list:
    return [("bars", S.VIEWS[view]), ("cleaned", S.clean("bars")),
            ("b", 'SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY "Timestamp") - 1 AS rn '
                  'FROM cleaned WHERE "Close" > 0')]


DIGITS = {"daily": 6, "hourly": 6, "supplier": 6}


def notebook_features_sql(view: str = "daily", drop_nulls: bool = True) -> str:
    ema_body, ema_name = S.ema_cte("b", notebook.ema_steps())
    a = [f'{_pct(chr(34) + "Close" + chr(34))} AS "Return"',
         f'"Close" - {_lag(chr(34) + "Close" + chr(34))} AS _delta',
         f'{_lag(chr(34) + "Close" + chr(34))} AS _prev_close',
         f'({S.div("lead(" + chr(34) + "Close" + chr(34) + ", 1) OVER (PARTITION BY " + W + ")", chr(34) + "Close" + chr(34))} - 1) AS "Target_Return"']
    for k in C.NB_LAGS:
        a += [f'{_lag(S.q("Close"), k)} AS "Price_Lag_{k}"', f'{_lag(S.q("Volume"), k)} AS "Volume_Lag_{k}"']
    a += [f'"Close" - {_lag(S.q("Close"), 1)} AS "Price_Change_1d"', f'"Close" - {_lag(S.q("Close"), 5)} AS "Price_Change_5d"']
    a += [f'{S.roll("avg", S.q("Close"), n, W)} AS "SMA_{n}"' for n in C.NB_SMA]
    a += [f'{S.roll("avg", S.q("Close"), C.NB_BB_WINDOW, W)} AS "BB_Middle"',
          f'{S.roll("stddev_samp", S.q("Close"), C.NB_BB_WINDOW, W)} AS "BB_Std"',
          f'{_pct(S.q("Volume"), 1)} AS "Volume_Change"', f'{_pct(S.q("Volume"), 5)} AS "Volume_Change_5d"']
    a += [f'{S.roll("avg", S.q("Volume"), n, W)} AS "Volume_MA_{n}"' for n in C.NB_VOLUME_MA]
    a += ['("High" + "Low" + "Close") / 3 AS "Typical_Price"']
    a += [f'({S.div(S.q("Close") + " - " + _lag(S.q("Close"), n), _lag(S.q("Close"), n))} * 100) AS "ROC_{n}"' for n in C.NB_ROC]
    a += [f'"Close" - {_lag(S.q("Close"), C.NB_MOMENTUM)} AS "Momentum_{C.NB_MOMENTUM}"',
          f'"Open" - {_lag(S.q("Close"))} AS "Gap"',
          f'CAST(sign("Close" - {_lag(S.q("Close"))}) AS DOUBLE) AS "Price_Direction"']
    lvl1 = f"""SELECT x.*, {', '.join(a)} FROM
  (SELECT b.*, e."EMA_12", e."EMA_26", e."EMA_50", e."MACD_Signal" FROM b JOIN ema_rec e USING (Ticker, rn)) x"""
    tp = '("Typical_Price" * "Volume")'
    bsel = [
        'CASE WHEN _delta > 0 THEN _delta ELSE 0.0 END AS _gain',
        'CASE WHEN _delta < 0 THEN -_delta ELSE 0.0 END AS _loss',
        'greatest("High" - "Low", abs("High" - _prev_close), abs("Low" - _prev_close)) AS _tr',
        f'{S.div(S.roll("sum", tp, C.NB_VWAP_WINDOW, W), S.roll("sum", S.q("Volume"), C.NB_VWAP_WINDOW, W))} AS "VWAP_20"',
        f'{_lag(chr(34) + "EMA_12" + chr(34) + " - " + chr(34) + "EMA_26" + chr(34))} AS _macd_prev',
        f'{_lag(S.q("MACD_Signal"))} AS _sig_prev',
        f'coalesce("Price_Direction" <> {_lag(S.q("Price_Direction"))}, true) AS _dir_change',
        f'CASE WHEN "Return" IS NULL THEN NULL ELSE sum("Volume" * "Return") OVER (PARTITION BY {W} ROWS UNBOUNDED PRECEDING) END AS "VPT"',
        f'sum(coalesce(sign("Close" - _prev_close) * "Volume", 0.0)) OVER (PARTITION BY {W} ROWS UNBOUNDED PRECEDING) AS "OBV"',
    ]
    bsel += [f'{_lag(S.q("Return"), k)} AS "Return_Lag_{k}"' for k in C.NB_LAGS]
    bsel += [f'{S.roll("stddev_samp", S.q("Return"), n, W)} AS "Volatility_{n}d"' for n in C.NB_VOL_WINDOWS]
    lvl2 = f"SELECT *, {', '.join(bsel)} FROM lvl1"
    csel = [f'{_pct(S.q("Volatility_20d"))} AS "Volatility_Change"',
            f'sum(CASE WHEN _dir_change THEN 1 ELSE 0 END) OVER (PARTITION BY {W} ROWS UNBOUNDED PRECEDING) AS _run']
    for n in C.NB_RSI:
        g, l_ = S.roll("avg", "_gain", n, W), S.roll("avg", "_loss", n, W)
        csel.append(f"CASE WHEN {l_} = 0 THEN CASE WHEN {g} > 0 THEN 100.0 END "
                    f"ELSE 100.0 - 100.0 / (1.0 + {g} / {l_}) END AS \"RSI_{n}\"")
    csel += [f'{S.roll("avg", "_tr", n, W)} AS "ATR_{n}"' for n in C.NB_ATR]
    lvl3 = f"SELECT *, {', '.join(csel)} FROM lvl2"
    lvl4 = f'SELECT *, sum("Price_Direction") OVER (PARTITION BY Ticker, _run ORDER BY "Timestamp" ROWS UNBOUNDED PRECEDING) AS "Consecutive_Up" FROM lvl3'

    def fl(cond):
        return f"CAST(coalesce({cond}, false) AS INTEGER)"

    up, lo = '("BB_Middle" + 2 * "BB_Std")', '("BB_Middle" - 2 * "BB_Std")'
    macd = '("EMA_12" - "EMA_26")'
    p = {}
    for n in C.NB_SMA:
        p[f"Price_to_SMA_{n}"] = f'({S.div(S.q("Close"), S.q(f"SMA_{n}"))} - 1)'
    for n in C.NB_EMA:
        p[f"Price_to_EMA_{n}"] = f'({S.div(S.q("Close"), S.q(f"EMA_{n}"))} - 1)'
    p["SMA_Cross_50_200"] = fl('"SMA_50" > "SMA_200"')
    p["EMA_Cross_12_26"] = fl('"EMA_12" > "EMA_26"')
    for n in C.NB_RSI:
        p[f"RSI_{n}_Oversold"] = fl(f'"RSI_{n}" < {C.NB_RSI_LOW}')
        p[f"RSI_{n}_Overbought"] = fl(f'"RSI_{n}" > {C.NB_RSI_HIGH}')
    p["MACD"] = macd
    p["MACD_Histogram"] = f'({macd} - "MACD_Signal")'
    p["MACD_Bullish"] = fl(f'{macd} > "MACD_Signal"')
    p["MACD_Crossover"] = fl(f'{macd} > "MACD_Signal" AND _macd_prev <= _sig_prev')
    p["BB_Upper"], p["BB_Lower"] = up, lo
    p["BB_Width"] = S.div(f"{up} - {lo}", S.q("BB_Middle"))
    p["BB_Position"] = S.div(f'"Close" - {lo}', f"{up} - {lo}")
    p["BB_Above_Upper"] = fl(f'"Close" > {up}')
    p["BB_Below_Lower"] = fl(f'"Close" < {lo}')
    for n in C.NB_ATR:
        p[f"ATR_{n}_Pct"] = f'({S.div(S.q(f"ATR_{n}"), S.q("Close"))} * 100)'
    for n in C.NB_VOL_WINDOWS:
        p[f"Volatility_{n}d_Ann"] = f'("Volatility_{n}d" * {math.sqrt(C.TRADING_DAYS)!r})'
    p["Realized_Vol"] = S.div('"High" - "Low"', S.q("Close"))
    p["Parkinson_Vol"] = f'sqrt({1.0 / (4.0 * math.log(2.0))!r} * pow(ln({S.div(S.q("High"), S.q("Low"))}), 2))'
    for n in C.NB_VOLUME_MA:
        p[f"Volume_Ratio_{n}"] = S.div(S.q("Volume"), S.q(f"Volume_MA_{n}"))
    p["Price_to_VWAP"] = f'({S.div(S.q("Close"), S.q("VWAP_20"))} - 1)'
    p["High_Low_Range"] = '("High" - "Low")'
    p["High_Low_Range_Pct"] = f'({S.div(chr(34) + "High" + chr(34) + " - " + chr(34) + "Low" + chr(34), S.q("Close"))} * 100)'
    p["Body_Size"] = 'abs("Close" - "Open")'
    p["Body_Size_Pct"] = f'({S.div("abs(" + chr(34) + "Close" + chr(34) + " - " + chr(34) + "Open" + chr(34) + ")", S.q("Close"))} * 100)'
    p["Upper_Shadow"] = '("High" - greatest("Open", "Close"))'
    p["Lower_Shadow"] = '(least("Open", "Close") - "Low")'
    p["Is_Bullish"] = fl('"Close" > "Open"')
    p["Gap_Pct"] = f'({S.div(S.q("Gap"), "_prev_close")} * 100)'
    p["Target_Direction"] = fl('"Target_Return" > 0')
    e = C.TARGET_CLASS_EDGES
    p["Target_Class"] = (f'CAST(CASE WHEN "Target_Return" IS NULL THEN NULL WHEN "Target_Return" <= {e[0]} THEN 0 '
                         f'WHEN "Target_Return" <= {e[1]} THEN 1 WHEN "Target_Return" <= {e[2]} THEN 2 '
                         f'WHEN "Target_Return" <= {e[3]} THEN 3 ELSE 4 END AS INTEGER)')
    t = '"Timestamp"'
    p["Day_of_Week"] = f"CAST(isodow({t}) - 1 AS INTEGER)"
    p["Is_Monday"] = f"CAST(isodow({t}) = 1 AS INTEGER)"
    p["Is_Friday"] = f"CAST(isodow({t}) = 5 AS INTEGER)"
    p["Month"] = f"CAST(month({t}) AS INTEGER)"
    p["Quarter"] = f"CAST(quarter({t}) AS INTEGER)"
    p["Day_of_Month"] = f"CAST(day({t}) AS INTEGER)"
    p["Is_Month_Start"] = f"CAST(day({t}) <= 5 AS INTEGER)"
    p["Is_Month_End"] = f"CAST(day({t}) >= 25 AS INTEGER)"
    p["Week_of_Year"] = f"CAST(weekofyear({t}) AS INTEGER)"
    p["Is_January"] = f"CAST(month({t}) = 1 AS INTEGER)"
    p["Is_December"] = f"CAST(month({t}) = 12 AS INTEGER)"
    p["Days_Since_Year_Start"] = f"CAST(dayofyear({t}) - 1 AS INTEGER)"
    lvl5 = "SELECT *, " + ", ".join(f'{v} AS "{k}"' for k, v in p.items()) + " FROM lvl4"
    sel = []
    for c in notebook.NOTEBOOK_COLUMNS:
        if c in ("Timestamp", "Ticker") or c in notebook.INT_COLUMNS:
            sel.append(S.q(c))
        else:
            sel.append(f"{S.r(S.q(c), DIGITS[view])} AS {S.q(c)}")
    where = ""
    if drop_nulls:
        where = "WHERE " + " AND ".join(f"{S.q(c)} IS NOT NULL" for c in notebook.NOTEBOOK_COLUMNS if "Target" not in c)
    return S.with_views(f"SELECT {', '.join(sel)} FROM lvl5 {where}", nb_source_sql(view) + [
        (ema_name, ema_body), ("lvl1", lvl1), ("lvl2", lvl2), ("lvl3", lvl3), ("lvl4", lvl4), ("lvl5", lvl5)])


def nb_bars(spark, sf_dir, view="daily"):
    return cleaning.drop_invalid_prices(cleaning.clean_market_data(getattr(fx, f"bars_{view}")(spark, sf_dir)))


def nb_features(spark, sf_dir, view="daily", drop_nulls=True):
    return notebook.notebook_features(nb_bars(spark, sf_dir, view), drop_nulls=drop_nulls)


@query("G36_notebook_features_daily", notebook_features_sql("daily"))
def q_nb_daily(spark, sf_dir):
    """G05-G35 + F05-F09 over the daily series, then the B18 null drop."""
    return output(nb_features(spark, sf_dir, "daily"), DIGITS["daily"])


@query("G05_G35_notebook_indicators_no_drop", notebook_features_sql("daily", drop_nulls=False))
def q_nb_raw(spark, sf_dir):
    """Every notebook indicator before the null drop (warm-up semantics of each column visible)."""
    return output(nb_features(spark, sf_dir, "daily", drop_nulls=False), DIGITS["daily"])


@query("G36_notebook_features_hourly", notebook_features_sql("hourly", drop_nulls=False))
def q_nb_hourly(spark, sf_dir):
    """The notebook dialect on the intraday series (short: kept before the null drop)."""
    return output(nb_features(spark, sf_dir, "hourly", drop_nulls=False))
