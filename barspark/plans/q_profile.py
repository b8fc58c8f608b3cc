"""Profiling / EDA queries (D rows, G01-G04, H06)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import output
from barspark.operators import cleaning, market, notebook, profile
from barspark.plans import sql as S
from barspark.plans.q_notebook import nb_features, notebook_features_sql
from barspark.plans.registry import query
from barspark.sources import fixtures as fx

W = 'Ticker ORDER BY "Timestamp"'
PRICES = C.PRICE_COLUMNS


def daily_clean(spark, sf_dir):
    return cleaning.clean_market_data(fx.bars_daily(spark, sf_dir))


def eda(spark, sf_dir):
    return profile.eda_frame(daily_clean(spark, sf_dir))


EDA_CTES = [("bars", S.BARS_DAILY), ("cleaned", S.clean("bars")),
            ("e1", f"""SELECT *, ({S.div('"Close"', 'lag("Close") OVER (PARTITION BY ' + W + ')')} - 1) * 100 AS "Daily_Return",
  {S.roll('avg', '"Close"', 20, W)} AS "MA_20", {S.roll('avg', '"Close"', 50, W)} AS "MA_50",
  {S.roll('avg', '"Close"', 200, W)} AS "MA_200", {S.roll('stddev_samp', '"Close"', 20, W)} AS _std20 FROM cleaned"""),
            ("eda", f"""SELECT * EXCLUDE (_std20), {S.roll('stddev_samp', '"Daily_Return"', 30, W)} AS "Volatility_30",
  "MA_20" + 2 * _std20 AS "BB_Upper_2s", "MA_20" - 2 * _std20 AS "BB_Lower_2s" FROM e1""")]


def eda_sql(body: str) -> str:
    return S.with_views(body, EDA_CTES)


@query("G01_G04_eda_frame", eda_sql(
    'SELECT "Timestamp", Ticker, ' + S.rcols(PRICES + ["Daily_Return", "MA_20", "MA_50", "MA_200", "Volatility_30",
                                                       "BB_Upper_2s", "BB_Lower_2s"]) + " FROM eda"))
def q_eda(spark, sf_dir):
    return output(eda(spark, sf_dir).select("Timestamp", "Ticker", *PRICES, "Daily_Return", "MA_20", "MA_50", "MA_200",
                                            "Volatility_30", "BB_Upper_2s", "BB_Lower_2s"))


NULL_COLS = C.BAR_COLUMNS
_null_union = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({S.q(c)}) AS null_count, count(*) AS n FROM bars" for c in NULL_COLS)


@query("D01_null_profile", S.with_views(f"""
SELECT "column", null_count, {S.r('null_count * 100.0 / n')} AS null_pct,
       sum(null_count) OVER () AS total_nulls, {S.r(f'sum(null_count) OVER () * 100.0 / (n * {len(NULL_COLS)})')} AS total_null_pct
FROM ({_null_union}) u""", [("bars", S.BARS_DIRTY)]))
def q_null_profile(spark, sf_dir):
    return output(profile.null_profile(fx.bars_dirty(spark, sf_dir), NULL_COLS))


@query("D02_duplicate_count", S.with_views("""
SELECT Ticker, sum(c) AS n_rows, sum(c - 1) AS duplicates
FROM (SELECT Ticker, "Timestamp", count(*) AS c FROM bars GROUP BY 1, 2) g GROUP BY Ticker""", [("bars", S.BARS_DIRTY)]))
def q_duplicates(spark, sf_dir):
    return output(profile.duplicate_count(fx.bars_dirty(spark, sf_dir), ["Ticker", "Timestamp"]))


@query("D03_D05_range_and_validation", S.with_views(f"""
SELECT Ticker, min("Timestamp") AS first_ts, max("Timestamp") AS last_ts, count(*) AS n_rows,
       CAST(date_diff('day', CAST(min("Timestamp") AS DATE), CAST(max("Timestamp") AS DATE)) AS INTEGER) AS span_days,
       {', '.join(f'sum(CAST({S.q(c)} <= 0 AS BIGINT)) AS {c}_non_positive' for c in ('Open', 'High', 'Low', 'Close'))},
       sum(CAST("Volume" = 0 AS BIGINT)) AS zero_volume,
       {S.r('sum(CAST("Volume" = 0 AS BIGINT)) * 100.0 / count(*)')} AS zero_volume_pct
FROM cleaned GROUP BY Ticker""", EDA_CTES[:2]))
def q_range_validation(spark, sf_dir):
    b = daily_clean(spark, sf_dir)
    return output(profile.range_profile(b).join(profile.price_validation(b), "Ticker"))


_desc_union = " UNION ALL ".join(f"SELECT Ticker, '{c}' AS \"column\", CAST({S.q(c)} AS DOUBLE) AS v FROM cleaned" for c in PRICES)


@query("D06_describe", S.with_views(f"""
SELECT Ticker, "column", count(v) AS "count", {S.r('avg(v)')} AS mean, {S.r('stddev_samp(v)')} AS std,
       {S.r('min(v)')} AS "min", {S.r('quantile_cont(v, 0.25)')} AS p25, {S.r('quantile_cont(v, 0.5)')} AS p50,
       {S.r('quantile_cont(v, 0.75)')} AS p75, {S.r('max(v)')} AS "max"
FROM ({_desc_union}) u GROUP BY Ticker, "column\"""", EDA_CTES[:2]))
def q_describe(spark, sf_dir):
    return output(profile.describe_bars(daily_clean(spark, sf_dir)))


@query("D07_price_performance", S.with_views(f"""
SELECT Ticker, {S.r('arg_min("Close", "Timestamp")')} AS start_price, {S.r('arg_max("Close", "Timestamp")')} AS current_price,
       {S.r('(arg_max("Close", "Timestamp") - arg_min("Close", "Timestamp")) / arg_min("Close", "Timestamp") * 100')} AS total_return_pct,
       {S.r('max("High")')} AS all_time_high, {S.r('min("Low")')} AS all_time_low, {S.r('max("High") - min("Low")')} AS price_range
FROM cleaned GROUP BY Ticker""", EDA_CTES[:2]))
def q_price_performance(spark, sf_dir):
    return output(profile.price_performance(daily_clean(spark, sf_dir)))


@query("D08_recent_candles", S.with_views(f"""
SELECT Ticker, sum(CAST("Close" > "Open" AS BIGINT)) AS up_bars, sum(CAST("Close" < "Open" AS BIGINT)) AS down_bars,
       {S.r('sum(CAST("Close" > "Open" AS BIGINT)) * 100.0 / count(*)')} AS up_pct,
       {S.r('sum(CAST("Close" < "Open" AS BIGINT)) * 100.0 / count(*)')} AS down_pct,
       {S.r('avg("High") - avg("Low")')} AS avg_range
FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY "Timestamp" DESC) AS k FROM cleaned) t
WHERE k <= 60 GROUP BY Ticker""", EDA_CTES[:2]))
def q_recent_candles(spark, sf_dir):
    return output(profile.recent_candles(daily_clean(spark, sf_dir), 60))


@query("D09_return_stats", eda_sql(f"""
SELECT Ticker, {S.r('avg("Daily_Return")')} AS mean_return, {S.r('quantile_cont("Daily_Return", 0.5)')} AS median_return,
       {S.r('stddev_samp("Daily_Return")')} AS std_return, {S.r('max("Daily_Return")')} AS best_return,
       {S.r('min("Daily_Return")')} AS worst_return,
       sum(CAST("Daily_Return" > 0 AS BIGINT)) AS positive_bars, sum(CAST("Daily_Return" < 0 AS BIGINT)) AS negative_bars,
       {S.r('sum(CAST("Daily_Return" > 0 AS BIGINT)) * 100.0 / count(*)')} AS positive_pct,
       {S.r('sum(CAST("Daily_Return" < 0 AS BIGINT)) * 100.0 / count(*)')} AS negative_pct
FROM eda GROUP BY Ticker"""))
def q_return_stats(spark, sf_dir):
    return output(profile.return_stats(eda(spark, sf_dir)))


@query("D10_ma_position", eda_sql(f"""
SELECT Ticker, "Timestamp", {S.r('"Close"')} AS price, {S.rcols(['MA_20', 'MA_50', 'MA_200'])},
       {', '.join(f"CASE WHEN coalesce(" + chr(34) + "Close" + chr(34) + f" > {S.q(m)}, false) THEN 'Above' ELSE 'Below' END AS {m}_position" for m in ('MA_20', 'MA_50', 'MA_200'))}
FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY "Timestamp" DESC) AS k FROM eda) t WHERE k = 1"""))
def q_ma_position(spark, sf_dir):
    return output(profile.ma_position(eda(spark, sf_dir)))


@query("D11_volatility_stats", eda_sql(f"""
SELECT Ticker, {S.r('arg_max("Volatility_30", "Timestamp")')} AS current_vol, {S.r('avg("Volatility_30")')} AS mean_vol,
       {S.r('max("Volatility_30")')} AS max_vol, {S.r('min("Volatility_30")')} AS min_vol
FROM eda GROUP BY Ticker"""))
def q_volatility_stats(spark, sf_dir):
    return output(profile.volatility_stats(eda(spark, sf_dir)))


def _corr_sql(a, b):
    return "1.0" if a == b else f"covar_samp({S.q(a)}, {S.q(b)}) / NULLIF(stddev_samp({S.q(a)}) * stddev_samp({S.q(b)}), 0)"


_corr_union = " UNION ALL ".join(
    f"SELECT Ticker, '{a}' AS a, '{b}' AS b, {_corr_sql(a, b)} AS c FROM cleaned GROUP BY Ticker" for a in PRICES for b in PRICES)


@query("D12_corr_matrix", S.with_views(f'SELECT Ticker, a, b, {S.r("c")} AS "corr" FROM ({_corr_union}) u', EDA_CTES[:2]))
def q_corr(spark, sf_dir):
    return output(profile.corr_matrix(daily_clean(spark, sf_dir)))


_pos = "CASE {x} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(PRICES)) + " END"


@query("D13_H06_top_corr_pairs", S.with_views(f"""
SELECT Ticker, a, b, {S.r('c')} AS "corr", CAST(rk AS INTEGER) AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY abs(c) DESC NULLS LAST, {_pos.format(x='a')}, {_pos.format(x='b')}) AS rk
  FROM ({_corr_union}) u WHERE {_pos.format(x='a')} < {_pos.format(x='b')}) t WHERE rk <= 5""", EDA_CTES[:2]))
def q_top_corr(spark, sf_dir):
    return output(profile.top_corr_pairs(daily_clean(spark, sf_dir)))


NB_FEATS = [c for c in notebook.NOTEBOOK_COLUMNS if c not in ("Timestamp", "Ticker") and "Target" not in c]
_tc_union = " UNION ALL ".join(
    f"SELECT Ticker, '{f}' AS feature, covar_samp({S.q(f)}, \"Target_Return\") / NULLIF(stddev_samp({S.q(f)}) * stddev_samp(\"Target_Return\"), 0) AS c FROM nb GROUP BY Ticker"
    for f in NB_FEATS)


@query("D14_H06_target_corr", S.with_views(f"""
SELECT Ticker, feature, {S.r('c')} AS "corr", CAST(rk AS INTEGER) AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY round(abs(c), 9) DESC NULLS LAST, feature) AS rk FROM ({_tc_union}) u
) t WHERE rk <= 20""", [("nb", notebook_features_sql("daily"))]))
def q_target_corr(spark, sf_dir):
    """Correlation of every notebook feature with the next-bar return (computed on unrounded values)."""
    return output(profile.target_corr(nb_features(spark, sf_dir, "daily"), NB_FEATS, "Target_Return", 20))


@query("D15_yearly_return", eda_sql(f"""
SELECT Ticker, CAST(year("Timestamp") AS INTEGER) AS "Year", {S.r('avg("Daily_Return") * 252')} AS annualized_return
FROM eda GROUP BY 1, 2"""))
def q_yearly(spark, sf_dir):
    return output(profile.yearly_return(eda(spark, sf_dir)))


@query("D16_monthly_return", eda_sql(f"""
SELECT Ticker, CAST(month("Timestamp") AS INTEGER) AS "Month", {S.r('avg("Daily_Return")')} AS mean_return FROM eda GROUP BY 1, 2"""))
def q_monthly(spark, sf_dir):
    return output(profile.monthly_return(eda(spark, sf_dir)))


@query("D17_weekday_profile", eda_sql(f"""
SELECT Ticker, CAST(isodow("Timestamp") - 1 AS INTEGER) AS "DayOfWeek", {S.r('avg("Daily_Return")')} AS mean_return,
       {S.r('avg("Volume")')} AS mean_volume FROM eda GROUP BY 1, 2"""))
def q_weekday(spark, sf_dir):
    return output(profile.weekday_profile(eda(spark, sf_dir)))


@query("D18_seasonal_extremes", eda_sql(f"""
SELECT m.Ticker, best_month, {S.r('best_month_return')} AS best_month_return, worst_month,
       {S.r('worst_month_return')} AS worst_month_return, best_weekday, {S.r('best_weekday_return')} AS best_weekday_return,
       worst_weekday, {S.r('worst_weekday_return')} AS worst_weekday_return
FROM (SELECT Ticker, arg_max(mo, r) AS best_month, max(r) AS best_month_return, arg_min(mo, r) AS worst_month, min(r) AS worst_month_return
      FROM (SELECT Ticker, CAST(month("Timestamp") AS INTEGER) AS mo, avg("Daily_Return") AS r FROM eda GROUP BY 1, 2) x GROUP BY Ticker) m
JOIN (SELECT Ticker, arg_max(d, r) AS best_weekday, max(r) AS best_weekday_return, arg_min(d, r) AS worst_weekday, min(r) AS worst_weekday_return
      FROM (SELECT Ticker, CAST(isodow("Timestamp") - 1 AS INTEGER) AS d, avg("Daily_Return") AS r FROM eda GROUP BY 1, 2) y GROUP BY Ticker) w
ON m.Ticker = w.Ticker"""))
def q_seasonal(spark, sf_dir):
    return output(profile.seasonal_extremes(eda(spark, sf_dir)))


_missing = " + ".join(f"sum(CAST({S.q(c)} IS NULL AS BIGINT))" for c in C.BAR_COLUMNS)


@query("D19_eda_summary", eda_sql(f"""
SELECT Ticker, count(*) AS n_rows, min("Timestamp") AS first_ts, max("Timestamp") AS last_ts,
       {S.r('arg_max("Close", "Timestamp")')} AS current_price, {S.r('max("High")')} AS all_time_high,
       {S.r('min("Low")')} AS all_time_low, {S.r('max("High") - min("Low")')} AS price_range,
       {S.r('avg("Daily_Return")')} AS mean_return, {S.r('stddev_samp("Daily_Return")')} AS std_return,
       {S.r('avg("Daily_Return") / NULLIF(stddev_samp("Daily_Return"), 0) * ' + repr(math.sqrt(252)))} AS sharpe_approx,
       {S.r('avg("Volume")')} AS avg_volume, {S.r('max("Volume")')} AS max_volume,
       {S.r('sum(CAST("Daily_Return" > 0 AS BIGINT)) * 100.0 / count(*)')} AS positive_pct,
       {_missing} AS missing_values,
       CASE WHEN {_missing} = 0 THEN 'Yes' ELSE 'Needs Cleaning' END AS ready
FROM eda GROUP BY Ticker"""))
def q_eda_summary(spark, sf_dir):
    return output(profile.eda_summary(eda(spark, sf_dir)))


@query("D20_iqr_outliers", S.with_views(f"""
SELECT c."Timestamp", c.Ticker, {S.r('c."Close"')} AS "Close", {S.r('f.lower')} AS lower, {S.r('f.upper')} AS upper,
       (c."Close" < f.lower OR c."Close" > f.upper) AS is_outlier
FROM cleaned c JOIN (SELECT Ticker, q1 - 3 * (q3 - q1) AS lower, q3 + 3 * (q3 - q1) AS upper FROM
  (SELECT Ticker, quantile_cont("Close", 0.25) AS q1, quantile_cont("Close", 0.75) AS q3 FROM cleaned GROUP BY Ticker) q) f
ON c.Ticker = f.Ticker""", [("bars", S.BARS_SUPPLIER), ("cleaned", S.clean("bars"))]))
def q_iqr(spark, sf_dir):
    """Fences per supplier series (many tickers) on the cleaned supplier bars."""
    b = cleaning.clean_market_data(fx.bars_supplier(spark, sf_dir))
    return output(profile.iqr_outliers(b).select("Timestamp", "Ticker", "Close", "lower", "upper", "is_outlier"))


@query("D21_histogram", eda_sql(f"""
SELECT Ticker, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(("Daily_Return" - lo) * 100 / (hi - lo)), 99) END AS INTEGER) AS bin,
       count(*) AS "count", {S.r('any_value(lo)')} AS lo, {S.r('any_value(hi)')} AS hi
FROM eda JOIN (SELECT Ticker, min("Daily_Return") AS lo, max("Daily_Return") AS hi FROM eda GROUP BY Ticker) r USING (Ticker)
WHERE "Daily_Return" IS NOT NULL GROUP BY 1, 2"""))
def q_histogram(spark, sf_dir):
    return output(profile.histogram(eda(spark, sf_dir), "Daily_Return", 100))


_any_null = " OR ".join(f"{S.q(c)} IS NULL" for c in C.BAR_COLUMNS)


@query("D22_D25_retention_report", S.with_views(f"""
SELECT b.Ticker, initial_rows, rows_with_nulls, coalesce(final_rows, 0) AS final_rows,
       initial_rows - coalesce(final_rows, 0) AS removed_rows, {S.r('coalesce(final_rows, 0) * 100.0 / initial_rows')} AS retention_pct
FROM (SELECT Ticker, count(*) AS initial_rows, sum(CAST({_any_null} AS BIGINT)) AS rows_with_nulls FROM bars GROUP BY Ticker) b
LEFT JOIN (SELECT Ticker, count(*) AS final_rows FROM cleaned GROUP BY Ticker) a ON a.Ticker = b.Ticker""",
    [("bars", S.BARS_DIRTY), ("cleaned", S.clean("bars"))]))
def q_retention(spark, sf_dir):
    before = fx.bars_dirty(spark, sf_dir)
    after = cleaning.clean_market_data(before)
    return output(profile.retention_report(before.select(*C.BAR_COLUMNS), after))


@query("D24_I02_stock_ids", S.with_views(
    "SELECT Ticker, CAST(row_number() OVER (ORDER BY Ticker) - 1 AS INTEGER) AS stock_id FROM (SELECT DISTINCT Ticker FROM cleaned) t",
    [("bars", S.BARS_SUPPLIER), ("cleaned", S.clean("bars"))]))
def q_stock_ids(spark, sf_dir):
    return output(profile.stock_ids(cleaning.clean_market_data(fx.bars_supplier(spark, sf_dir))))


@query("D27_bars_per_ticker", S.with_views("SELECT Ticker, count(*) AS n_rows FROM bars GROUP BY Ticker",
                                           [("bars", S.BARS_SUPPLIER)]))
def q_bars_per_ticker(spark, sf_dir):
    return output(profile.bars_per_ticker(fx.bars_supplier(spark, sf_dir)))
