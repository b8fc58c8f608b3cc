"""Package-dialect feature queries (E rows, F01-F03)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barspark import config
from barspark.config import FeatureSettings
from barspark.functions.columns import output
from barspark.operators import cleaning, indicators
from barspark.plans import sql as S
from barspark.plans.registry import query
from barspark.sources import fixtures as fx

TARGETS = [f"target_t{h}" for h in range(1, config.HORIZON + 1)]
INT_FEATURES = {"hour", "day_of_week"}


DIGITS = {"daily": 6, "hourly": 6, "supplier": 6}


def package_features_sql(view: str = "hourly", drop_nulls: bool = True, rounded: bool = True) -> str:
    """E09 in SQL: clean -> number rows -> EMA recursion -> windows -> calendar -> drop NULL rows."""
    s = FeatureSettings()
    steps = indicators.package_steps(s)
    ema_body, ema_name = S.ema_cte("b", steps)
    w = 'Ticker ORDER BY "Timestamp"'
    rolls = ", ".join(
        f"{S.roll('avg', 'c.\"Close\"', n, w)} AS rolling_mean_{n}, {S.roll('stddev_samp', 'c.\"Close\"', n, w)} AS rolling_std_{n}"
        for n in s.rolling_windows)
    leads = ", ".join(f'lead(c."Close", {h}) OVER (PARTITION BY {w}) AS target_t{h}' for h in range(1, s.horizon + 1))
    lvl1 = f"""
SELECT c.*,
       {S.div('c."Close"', 'lag(c."Close") OVER (PARTITION BY ' + w + ')')} - 1 AS return_1,
       c."Close" - lag(c."Close") OVER (PARTITION BY {w}) AS delta,
       {rolls}, {leads}
FROM (SELECT b.*, e.ema_fast, e.ema_slow, e.macd_signal FROM b JOIN ema_rec e USING (Ticker, rn)) c"""
    n = s.rsi_window
    lvl2 = f"""
SELECT *, e1.ema_fast - e1.ema_slow AS macd,
       {S.roll('avg', 'CASE WHEN delta IS NULL THEN NULL ELSE greatest(delta, 0.0) END', n, w)} AS g,
       {S.roll('avg', 'CASE WHEN delta IS NULL THEN NULL ELSE greatest(-delta, 0.0) END', n, w)} AS l
FROM lvl1 e1"""
    loc = S.local()
    two_pi = repr(2 * math.pi)
    lvl3 = f"""
SELECT *, macd - macd_signal AS macd_hist,
       coalesce(100.0 - 100.0 / (1.0 + g / NULLIF(l, 0)), 100.0) AS rsi,
       CAST(hour({loc}) AS INTEGER) AS hour, CAST({S.weekday(loc)} AS INTEGER) AS day_of_week
FROM lvl2"""
    lvl4 = f"""
SELECT *, sin({two_pi} * hour / 24) AS hour_sin, cos({two_pi} * hour / 24) AS hour_cos,
       sin({two_pi} * day_of_week / 7) AS day_sin, cos({two_pi} * day_of_week / 7) AS day_cos
FROM lvl3"""
    dbl = [c for c in config.PACKAGE_FEATURES if c not in INT_FEATURES] + TARGETS
    cols = ", ".join(S.r(S.q(c), DIGITS[view]) + f" AS {S.q(c)}" if c in dbl and rounded else S.q(c)
                     for c in config.PACKAGE_FEATURES + TARGETS)
    where = ""
    if drop_nulls:
        where = "WHERE " + " AND ".join(f"{S.q(c)} IS NOT NULL" for c in config.PACKAGE_FEATURES + TARGETS)
    return S.with_views(f'SELECT "Timestamp", Ticker, {cols} FROM lvl4 {where}', [
        ("bars", S.VIEWS[view]),
        ("cleaned", S.clean("bars")),
        ("b", 'SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY "Timestamp") - 1 AS rn FROM cleaned'),
        (ema_name, ema_body),
        ("lvl1", lvl1), ("lvl2", lvl2), ("lvl3", lvl3), ("lvl4", lvl4),
    ])


def features(spark, sf_dir, view="hourly"):
    bars = cleaning.clean_market_data(getattr(fx, f"bars_{view}")(spark, sf_dir))
    return indicators.feature_frame(bars)


@query("E09_feature_frame_hourly", package_features_sql("hourly"))
def q_features_hourly(spark, sf_dir):
    """Flagship: hourly bars -> clean -> 24 features + 3 targets (the training feature table)."""
    return output(features(spark, sf_dir, "hourly"))


@query("E09_feature_frame_daily", package_features_sql("daily"))
def q_features_daily(spark, sf_dir):
    return output(features(spark, sf_dir, "daily"), DIGITS["daily"])


@query("E02_E05_indicators_no_drop", package_features_sql("hourly", drop_nulls=False))
def q_indicators_raw(spark, sf_dir):
    """The same columns before the NULL-row drop (warm-up rows visible: RSI 100 fill, NULL rolls)."""
    bars = cleaning.clean_market_data(fx.bars_hourly(spark, sf_dir))
    return output(indicators.feature_frame(bars, drop_nulls=False))


@query("E10_latest_rows", S.with_views(
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY \"Timestamp\" DESC) AS k FROM f) x "
    "WHERE k <= 10", [("f", "(" + package_features_sql("hourly") + ")")]).replace("SELECT * FROM (SELECT *, row_number()", "SELECT * EXCLUDE (k) FROM (SELECT *, row_number()"))
def q_latest_rows(spark, sf_dir):
    return output(indicators.latest_rows(features(spark, sf_dir, "hourly"), 10))
