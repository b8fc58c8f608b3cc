"""Data profiling / EDA aggregates.

Everything is a grouped aggregate with partial (map-side) aggregation; percentiles are exact, by
distributed selection (``quantiles``, linear interpolation like pandas).
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import pct_change, roll_mean, roll_std, safe_div
from barspark.operators.quantiles import exact_quantiles
from barspark.plans import series
from barspark.session import materialize as _materialize

SQRT_252 = math.sqrt(C.TRADING_DAYS)


def eda_frame(bars: DataFrame, keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Daily_Return (%), MA_20/50/200, Volatility_30 and the 2-sigma bands."""
    def build(d: DataFrame, w: Window) -> DataFrame:
        d = d.withColumns({"Daily_Return": pct_change("Close", 1, w) * 100,
                           "MA_20": roll_mean("Close", 20, w), "MA_50": roll_mean("Close", 50, w),
                           "MA_200": roll_mean("Close", 200, w), "_std20": roll_std("Close", 20, w)})
        return d.withColumns({"Volatility_30": roll_std("Daily_Return", 30, w),
                              "BB_Upper_2s": F.col("MA_20") + 2 * F.col("_std20"),
                              "BB_Lower_2s": F.col("MA_20") - 2 * F.col("_std20")}).drop("_std20")

    return _materialize(series.run_ordered(bars.drop("_seq"), build, halo=200, keys=keys))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count and percent per column, plus the cell total, in one pass."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    stacked = agg.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count"))
                                                  for c in cols])).alias("s"))
    out = stacked.select(F.col("s.column").alias("column"), F.col("s.null_count").alias("null_count"),
                         (F.col("s.null_count") * 100.0 / F.col("_n")).alias("null_pct"), "_n")
    total = F.sum("null_count").over(Window.partitionBy()).alias("total_nulls")
    return out.select("column", "null_count", "null_pct", total,
                      (F.sum("null_count").over(Window.partitionBy()) * 100.0 / (F.col("_n") * len(cols))).alias("total_null_pct"))


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None, keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Rows beyond the first of each (subset) group, per key."""
    subset = list(subset or df.columns)
    g = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("_c"))
    return g.groupBy(*keys).agg(F.sum("_c").alias("n_rows"), F.sum(F.col("_c") - 1).alias("duplicates"))


def range_profile(df: DataFrame) -> DataFrame:
    """first/last stamp, span in days, rows."""
    return df.groupBy("Ticker").agg(F.min("Timestamp").alias("first_ts"), F.max("Timestamp").alias("last_ts"),
                                    F.count(F.lit(1)).alias("n_rows")).withColumn(
        "span_days", F.datediff(F.col("last_ts"), F.col("first_ts")))


def price_validation(df: DataFrame) -> DataFrame:
    """D04 + D05: non-positive price counts per column and zero-volume count/percent."""
    n = F.count(F.lit(1))
    return df.groupBy("Ticker").agg(
        *[F.sum((F.col(c) <= 0).cast("long")).alias(f"{c}_non_positive") for c in ("Open", "High", "Low", "Close")],
        F.sum((F.col("Volume") == 0).cast("long")).alias("zero_volume"),
        (F.sum((F.col("Volume") == 0).cast("long")) * 100.0 / n).alias("zero_volume_pct"))


def describe_bars(df: DataFrame, cols: Sequence[str] = tuple(C.PRICE_COLUMNS)) -> DataFrame:
    """Count, mean, std, min, 25/50/75%, max per ticker and column (long format)."""
    q = exact_quantiles(df, ["Ticker"], {c: c for c in cols}, (0.25, 0.5, 0.75), {
        "count": F.count("v"), "mean": F.avg("v"), "std": F.stddev_samp("v"), "min": F.min("v"), "max": F.max("v")})
    return q.select("Ticker", "column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
                    F.col("q")[2].alias("p75"), "max")


def price_performance(df: DataFrame) -> DataFrame:
    """first/last close, total return %, all-time high/low and range."""
    first, last = F.min_by("Close", "Timestamp"), F.max_by("Close", "Timestamp")
    return df.groupBy("Ticker").agg(first.alias("start_price"), last.alias("current_price"),
                                    ((last - first) / first * 100).alias("total_return_pct"),
                                    F.max("High").alias("all_time_high"), F.min("Low").alias("all_time_low"),
                                    (F.max("High") - F.min("Low")).alias("price_range"))


def recent_candles(df: DataFrame, n: int = 60) -> DataFrame:
    """Over the last n bars: up/down bar counts and %, mean High - mean Low."""
    last = series.latest_n(df, n)
    cnt = F.count(F.lit(1))
    return last.groupBy("Ticker").agg(
        F.sum((F.col("Close") > F.col("Open")).cast("long")).alias("up_bars"),
        F.sum((F.col("Close") < F.col("Open")).cast("long")).alias("down_bars"),
        (F.sum((F.col("Close") > F.col("Open")).cast("long")) * 100.0 / cnt).alias("up_pct"),
        (F.sum((F.col("Close") < F.col("Open")).cast("long")) * 100.0 / cnt).alias("down_pct"),
        (F.avg("High") - F.avg("Low")).alias("avg_range"))


def return_stats(eda: DataFrame) -> DataFrame:
    """mean/median/std/best/worst daily return; % positive/negative over all rows."""
    r, n = F.col("v"), F.count(F.lit(1))
    up, down = F.sum((r > 0).cast("long")), F.sum((r < 0).cast("long"))
    q = exact_quantiles(eda, ["Ticker"], {"Daily_Return": "Daily_Return"}, (0.5,), {
        "mean_return": F.avg(r), "std_return": F.stddev_samp(r), "best_return": F.max(r), "worst_return": F.min(r),
        "positive_bars": up, "negative_bars": down, "positive_pct": up * 100.0 / n, "negative_pct": down * 100.0 / n})
    return q.select("Ticker", "mean_return", F.col("q")[0].alias("median_return"), "std_return", "best_return", "worst_return",
                    "positive_bars", "negative_bars", "positive_pct", "negative_pct")


def ma_position(eda: DataFrame) -> DataFrame:
    """Latest price against MA20/50/200 (a NULL average counts as Below)."""
    latest = series.latest_n(eda, 1)
    out = latest.select("Ticker", "Timestamp", F.col("Close").alias("price"), "MA_20", "MA_50", "MA_200")
    for m in ("MA_20", "MA_50", "MA_200"):
        out = out.withColumn(f"{m}_position", F.when(F.coalesce(F.col("price") > F.col(m), F.lit(False)), "Above")
                             .otherwise("Below"))
    return out


def volatility_stats(eda: DataFrame) -> DataFrame:
    """Current (latest bar), mean, max, min of the 30-bar volatility."""
    v = F.col("Volatility_30")
    return eda.groupBy("Ticker").agg(F.max_by(v, "Timestamp").alias("current_vol"), F.avg(v).alias("mean_vol"),
                                     F.max(v).alias("max_vol"), F.min(v).alias("min_vol"))


def corr_expr(a: str, b: str) -> Column:
    """Pearson correlation guarded for constant columns (T9): cov / (sd_a sd_b) with try_divide."""
    return safe_div(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def corr_matrix(df: DataFrame, cols: Sequence[str] = tuple(C.PRICE_COLUMNS), keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """All column pairs in one aggregate, long output (key, a, b, corr)."""
    cols = list(cols)
    pairs = [(a, b) for a in cols for b in cols]
    agg = df.groupBy(*keys).agg(*[(F.lit(1.0) if a == b else corr_expr(a, b)).alias(f"{a}|{b}") for a, b in pairs])
    return agg.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                                          F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("s")
                      ).select(*keys, "s.a", "s.b", "s.corr")


def top_corr_pairs(df: DataFrame, cols: Sequence[str] = tuple(C.PRICE_COLUMNS), k: int = 5) -> DataFrame:
    """Upper triangle (a listed before b) by |corr| descending, top k per ticker."""
    pos = {c: i for i, c in enumerate(cols)}
    idx = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(pos[c]))])
    m = corr_matrix(df, cols).filter(idx[F.col("a")] < idx[F.col("b")])
    w = Window.partitionBy("Ticker").orderBy(F.abs("corr").desc_nulls_last(), idx[F.col("a")], idx[F.col("b")])
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def target_corr(df: DataFrame, features: Sequence[str], target: str, k: int = 20) -> DataFrame:
    """Correlation of every feature with the target, |corr| descending, top k per ticker."""
    feats = [f for f in features if f != target]
    agg = df.groupBy("Ticker").agg(*[corr_expr(f, target).alias(f) for f in feats])
    long = agg.select("Ticker", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("corr"))
                                                   for f in feats])).alias("s")).select("Ticker", "s.feature", "s.corr")
    # Scaled copies (e.g. a volatility and its annualised twin) tie exactly; compare |corr| at
    # 1e-9 so the tie is broken by name rather than by floating-point noise.
    w = Window.partitionBy("Ticker").orderBy(F.round(F.abs("corr"), 9).desc_nulls_last(), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def yearly_return(eda: DataFrame) -> DataFrame:
    """Mean daily return x 252 per calendar year."""
    return eda.groupBy("Ticker", F.year("Timestamp").alias("Year")).agg(
        (F.avg("Daily_Return") * C.TRADING_DAYS).alias("annualized_return"))


def monthly_return(eda: DataFrame) -> DataFrame:
    """D16."""
    return eda.groupBy("Ticker", F.month("Timestamp").alias("Month")).agg(F.avg("Daily_Return").alias("mean_return"))


def weekday_profile(eda: DataFrame) -> DataFrame:
    """Mean return and mean volume per weekday (Mon=0)."""
    return eda.groupBy("Ticker", F.weekday("Timestamp").alias("DayOfWeek")).agg(
        F.avg("Daily_Return").alias("mean_return"), F.avg("Volume").alias("mean_volume"))


def seasonal_extremes(eda: DataFrame) -> DataFrame:
    """best/worst month and weekday by mean return."""
    m = monthly_return(eda).groupBy("Ticker").agg(
        F.max_by("Month", "mean_return").alias("best_month"), F.max("mean_return").alias("best_month_return"),
        F.min_by("Month", "mean_return").alias("worst_month"), F.min("mean_return").alias("worst_month_return"))
    d = weekday_profile(eda).groupBy("Ticker").agg(
        F.max_by("DayOfWeek", "mean_return").alias("best_weekday"), F.max("mean_return").alias("best_weekday_return"),
        F.min_by("DayOfWeek", "mean_return").alias("worst_weekday"), F.min("mean_return").alias("worst_weekday_return"))
    return m.join(d, "Ticker")


def eda_summary(eda: DataFrame, raw_cols: Sequence[str] = tuple(C.BAR_COLUMNS)) -> DataFrame:
    """One row per ticker with the headline numbers and a readiness verdict."""
    r = F.col("Daily_Return")
    missing = sum([F.sum(F.col(c).isNull().cast("long")) for c in raw_cols], F.lit(0))
    out = eda.groupBy("Ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("Timestamp").alias("first_ts"), F.max("Timestamp").alias("last_ts"),
        F.max_by("Close", "Timestamp").alias("current_price"), F.max("High").alias("all_time_high"),
        F.min("Low").alias("all_time_low"), (F.max("High") - F.min("Low")).alias("price_range"),
        F.avg(r).alias("mean_return"), F.stddev_samp(r).alias("std_return"),
        (safe_div(F.avg(r), F.stddev_samp(r)) * F.lit(SQRT_252)).alias("sharpe_approx"),
        F.avg("Volume").alias("avg_volume"), F.max("Volume").alias("max_volume"),
        (F.sum((r > 0).cast("long")) * 100.0 / F.count(F.lit(1))).alias("positive_pct"),
        missing.alias("missing_values"))
    return out.withColumn("ready", F.when(F.col("missing_values") == 0, "Yes").otherwise("Needs Cleaning"))


def iqr_outliers(df: DataFrame, k: float = 3.0, col: str = "Close") -> DataFrame:
    """Per-ticker fences Q1-k*IQR, Q3+k*IQR (exact percentiles); rows flagged, not removed."""
    q = exact_quantiles(df, ["Ticker"], {col: col}, (0.25, 0.75))
    fences = q.select("Ticker", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    fences = fences.select("Ticker", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"),
                           (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"))
    # One row per ticker: joined back by key (AQE broadcasts it when small, shuffles otherwise).
    return df.join(fences, "Ticker").withColumn(
        "is_outlier", (F.col(col) < F.col("lower")) | (F.col(col) > F.col("upper")))


def histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Equal-width bins between the per-ticker min and max (max falls in the last bin)."""
    rng = df.groupBy("Ticker").agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    d = df.filter(F.col(col).isNotNull()).join(rng, "Ticker")
    raw = F.floor((F.col(col) - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    return d.groupBy("Ticker", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"),
                                                  F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def retention_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """D22 + D25: rows with any NULL before, rows kept, removed, retention % per ticker."""
    any_null = F.lit(False)
    for c in before.columns:
        any_null = any_null | F.col(c).isNull()
    b = before.groupBy("Ticker").agg(F.count(F.lit(1)).alias("initial_rows"),
                                     F.sum(any_null.cast("long")).alias("rows_with_nulls"))
    a = after.groupBy("Ticker").agg(F.count(F.lit(1)).alias("final_rows"))
    return (b.join(a, "Ticker", "left").fillna(0, subset=["final_rows"])
            .withColumn("removed_rows", F.col("initial_rows") - F.col("final_rows"))
            .withColumn("retention_pct", F.col("final_rows") * 100.0 / F.col("initial_rows")))


def stock_ids(df: DataFrame) -> DataFrame:
    """Distinct sorted tickers -> dense ids from 0 (one row per ticker)."""
    return series.number_by_key(df.select("Ticker").distinct(), "Ticker", "stock_id")


def bars_per_ticker(df: DataFrame) -> DataFrame:
    """D27."""
    return df.groupBy("Ticker").agg(F.count(F.lit(1)).alias("n_rows"))
