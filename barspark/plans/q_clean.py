"""Queries for sources views, market filters and cleaning (A, B rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark import config
from barspark.functions.columns import output
from barspark.operators import cleaning, market
from barspark.plans import sql as S
from barspark.plans.registry import query
from barspark.sources import fixtures as fx

BAR_OUT = '"Timestamp", Ticker, ' + S.rcols(config.PRICE_COLUMNS)


def _bars_out(df):
    return output(df.select(*config.BAR_COLUMNS))


# --- B07 cadence ---------------------------------------------------------------------------------
for _view in ("hourly", "daily"):
    def _make(view):
        @query(f"B07_cadence_{view}", S.with_views(
            f"SELECT Ticker, n_bars, {S.r('median_gap_seconds')} AS median_gap_seconds, is_daily FROM ({S.cadence('bars')}) c",
            [("bars", S.VIEWS[view])]))
        def _q(spark, sf_dir):
            b = getattr(fx, f"bars_{view}")(spark, sf_dir)
            return output(market.bar_cadence(b).select("Ticker", "n_bars", "median_gap_seconds", "is_daily"))
    _make(_view)


# --- B03-B06 market columns --------------------------------------------------------------------------
@query("B03_B06_session_flags", S.with_views(f"""
SELECT "Timestamp", Ticker, CASE WHEN {S.india()} THEN 'IN' ELSE 'US' END AS market,
       {S.tz()} AS timezone, {S.open_min()} AS open_min, {S.close_min()} AS close_min,
       {S.local()} AS local_ts, {S.weekday(S.local())} < 5 AS is_weekday,
       hour({S.local()}) * 60 + minute({S.local()}) BETWEEN {S.open_min()} AND {S.close_min()} AS in_session
FROM bars""", [("bars", S.BARS_HOURLY)]))
def q_session_flags(spark, sf_dir):
    b = market.with_market(fx.bars_hourly(spark, sf_dir))
    b = market.session_bars(b)
    return output(b.select("Timestamp", "Ticker", "market", "timezone", "open_min", "close_min",
                           F.col("local_ts").cast("timestamp_ntz").alias("local_ts"), "is_weekday", "in_session"))


# --- B08 trading hours ---------------------------------------------------------------------------
for _view in ("hourly", "daily", "dirty"):
    def _make(view):
        @query(f"B08_trading_hours_{view}", S.with_views(
            f"SELECT {BAR_OUT}, _seq FROM ({S.trading_hours('bars')}) t", [("bars", S.VIEWS[view])]))
        def _q(spark, sf_dir):
            b = getattr(fx, f"bars_{view}")(spark, sf_dir)
            return output(market.filter_trading_hours(b).select(*config.BAR_COLUMNS, "_seq"))
    _make(_view)


# --- B09 dedup ----------------------------------------------------------------------------------
@query("B09_dedup_first", S.with_views(f"""
SELECT {BAR_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY Ticker, "Timestamp" ORDER BY _seq) AS k FROM bars) d
WHERE k = 1""", [("bars", S.BARS_DIRTY)]))
def q_dedup(spark, sf_dir):
    return _bars_out(market.dedup_first(fx.bars_dirty(spark, sf_dir)))


# --- B10/B11 fill ---------------------------------------------------------------------------------
def _fill_sql(scope):
    cols = config.PRICE_COLUMNS
    ff = ", ".join(f'last_value({S.q(c)} IGNORE NULLS) OVER (PARTITION BY Ticker ORDER BY "Timestamp" '
                   f'ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {S.q(c)}' for c in cols)
    bf = ", ".join(f'first_value({S.q(c)} IGNORE NULLS) OVER (PARTITION BY Ticker ORDER BY "Timestamp" '
                   f'ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {S.q(c)}' for c in cols)
    body = f'SELECT "Timestamp", Ticker, {bf} FROM (SELECT "Timestamp", Ticker, {ff} FROM dedup) f'
    if scope == "global":
        gx = ", ".join(f'coalesce({S.q(c)}, first_value({S.q(c)} IGNORE NULLS) OVER (ORDER BY Ticker, "Timestamp" '
                       f'ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {S.q(c)}' for c in cols)
        body = f'SELECT "Timestamp", Ticker, {gx} FROM ({body}) g'
    dedup = ('SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Ticker, "Timestamp" ORDER BY _seq) AS k '
             'FROM bars) d WHERE k = 1')
    return S.with_views(f"SELECT {BAR_OUT} FROM ({body}) z", [("bars", S.BARS_DIRTY), ("dedup", dedup)])


for _scope in ("ticker", "global"):
    def _make(scope):
        @query(f"B10_B11_fill_{scope}", _fill_sql(scope))
        def _q(spark, sf_dir):
            d = market.dedup_first(fx.bars_dirty(spark, sf_dir))
            return _bars_out(cleaning.fill_ohlcv(d, scope=scope))
    _make(_scope)


# --- B12/B13 clean pipeline ----------------------------------------------------------------------
for _view, _scope in (("hourly", "ticker"), ("dirty", "ticker"), ("dirty", "global"), ("daily", "ticker")):
    def _make(view, scope):
        @query(f"B13_clean_{view}_{scope}", S.with_views(
            f"SELECT {BAR_OUT} FROM ({S.clean('bars', scope)}) c", [("bars", S.VIEWS[view])]))
        def _q(spark, sf_dir):
            b = getattr(fx, f"bars_{view}")(spark, sf_dir)
            return _bars_out(cleaning.clean_market_data(b, scope=scope))
    _make(_view, _scope)
