"""Forecast evaluation, trading backtests, ensembles and intervals.

All models and tickers are evaluated in one job over a long table (Model, Ticker, Timestamp, y,
yhat): per-series lags run on the chunked series plan; sums, moments, equity curve and drawdown are
one row per chunk that composes with its neighbours (backtest.py).
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import round_sig, safe_div
from barspark.operators.backtest import series_summaries
from barspark.operators.quantiles import exact_quantiles
from barspark.plans import series
from barspark.plans.series import RN
from barspark.session import materialize

KEYS = ("Model", "Ticker")
SQRT_252 = math.sqrt(C.TRADING_DAYS)


def naive_predictions(bars: DataFrame) -> DataFrame:
    """Deterministic forecasters over each ticker's Close (the evaluation fixture):
    ``naive`` = previous close, ``sma5`` = mean of the 5 previous closes, ``lag5`` = close 5 bars back."""
    def build(d, w):
        prev5 = w.rowsBetween(-5, -1)
        return d.withColumns({"naive": F.lag("Close", 1).over(w),
                              "sma5": F.when(F.count("Close").over(prev5) == 5, F.avg("Close").over(prev5)),
                              "lag5": F.lag("Close", 5).over(w)})

    d = series.run_ordered(bars.select("Timestamp", "Ticker", "Close"), build, halo=5)
    long = d.select("Timestamp", "Ticker", F.col("Close").alias("y"),
                    F.explode(F.array(*[F.struct(F.lit(m).alias("Model"), F.col(m).alias("yhat"))
                                        for m in ("naive", "sma5", "lag5")])).alias("p"))
    return long.select("p.Model", "Ticker", "Timestamp", "y", "p.yhat").filter(F.col("yhat").isNotNull())


def _steps(preds: DataFrame) -> DataFrame:
    """Per-row lags and strategy legs for both metric flavours."""
    def build(d, w):
        y0, p0 = F.lag("y").over(w), F.lag("yhat").over(w)
        d = d.withColumns({"_dy": F.col("y") - y0, "_dp": F.col("yhat") - p0, "_r": safe_div(F.col("y") - y0, y0),
                           "_up_eq": (F.col("y") > y0) == (F.col("yhat") > p0)})
        d = d.withColumns({"_sig": F.signum("_dp"),
                           "_ret_b": F.when(F.col("_dp").isNotNull(),
                                            F.when(F.col("yhat") > p0, F.col("_r")).otherwise(F.lit(0.0)))})
        return d.withColumns({"_trade": F.abs(F.col("_sig") - F.lag("_sig").over(w)),
                              "_strat": F.col("_r") * F.col("_sig"),
                              "_dir_a": (F.signum("_dy") == F.col("_sig")).cast("double")})

    return series.run_ordered(preds, build, halo=2, keys=KEYS, keep_index=True)


def _count(c: Column) -> Column:
    return c.isNotNull().cast("double")


def _error_sums(extra: dict[str, Column]) -> dict[str, Column]:
    e = F.col("y") - F.col("yhat")
    return {"_se": e * e, "_ae": F.abs(e), "_ne": _count(e), "_rows": F.lit(1.0), **extra}


def validation_metrics(preds: DataFrame) -> DataFrame:
    """L12 (validation flavour): RMSE, MAE, MAPE, R2, directional accuracy (sign), long/short
    strategy with smeared costs, Sharpe (risk-free, sample std), max drawdown, total return, trades.

    The cost of a step needs the series' trades, so the steps are written once and read twice: for
    those totals (a row per series) and for the summaries."""
    d = materialize(_steps(preds))
    cost = F.lit(C.TRANSACTION_COST) * F.coalesce(F.col("_trades"), F.lit(0.0)) / (F.col("_n") - 1)
    per = (d.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.sum("_trade").alias("_trades"))
           .select(*KEYS, F.when(F.col("_n") > 1, cost).alias("_cost")))
    net = F.col("_strat") - F.col("_cost")
    ape = F.abs(safe_div(F.col("y") - F.col("yhat"), F.col("y")))
    s = series_summaries(d.join(per, list(KEYS)), net, _error_sums(
        {"_ape": ape, "_nape": _count(ape), "_right": F.col("_dir_a"), "_nright": _count(F.col("_dir_a")), "_trades": F.col("_trade")}),
        {"_y": F.col("y"), "_net": net}, KEYS)
    n, mean = F.col("_net.n"), F.col("_net.mean") - F.lit(C.RISK_FREE_RATE / C.TRADING_DAYS)
    sd = F.sqrt(F.when(n > 1, safe_div(F.col("_net.m2"), n - 1)))
    return s.select(
        *KEYS, F.sqrt(safe_div(F.col("_se"), F.col("_ne"))).alias("RMSE"), safe_div(F.col("_ae"), F.col("_ne")).alias("MAE"),
        (safe_div(F.col("_ape"), F.col("_nape")) * 100).alias("MAPE"),
        (F.lit(1.0) - safe_div(F.col("_se"), F.col("_y.m2"))).alias("R2"),
        (safe_div(F.col("_right"), F.col("_nright")) * 100).alias("Dir_Accuracy_pct"),
        F.when(sd == 0, F.lit(0.0)).otherwise(safe_div(F.lit(SQRT_252) * mean, sd)).alias("Sharpe_Ratio"),
        (F.col("drawdown") * 100).alias("Max_Drawdown_pct"),
        # Compounded returns span many orders of magnitude: kept to 10 significant digits.
        round_sig((F.col("curve_end") - 1) * 100).alias("Total_Return_pct"),
        F.coalesce("_trades", F.when(F.col("_ne") > 0, F.lit(0.0))).alias("Num_Trades"))


def test_metrics(preds: DataFrame) -> DataFrame:
    """L13 (test flavour): MAPE with 1e-10, directional accuracy on up-flags, long/cash strategy,
    Sharpe with population std and no risk-free rate, drawdown and cumulative return. A model
    without a valid forecast has NULL metrics, never the 0 of a strategy that stands still."""
    right = F.when(F.col("_dp").isNotNull(), F.col("_up_eq").cast("double"))
    ape = F.abs((F.col("y") - F.col("yhat")) / (F.col("y") + F.lit(C.MAPE_EPSILON)))
    s = series_summaries(_steps(preds), F.col("_ret_b"), _error_sums(
        {"_ape": ape, "_right": right, "_nright": _count(right)}), {"_ret": F.col("_ret_b")}, KEYS)
    zero = F.when(F.col("_ne") > 0, F.lit(0.0))
    sd = F.sqrt(safe_div(F.col("_ret.m2"), F.col("_ret.n")))
    return s.select(
        *KEYS, F.sqrt(safe_div(F.col("_se"), F.col("_ne"))).alias("RMSE"), safe_div(F.col("_ae"), F.col("_ne")).alias("MAE"),
        (safe_div(F.col("_ape"), F.col("_ne")) * 100).alias("MAPE_pct"),
        F.when(F.col("_rows") > 1, safe_div(F.col("_right"), F.col("_nright")) * 100).otherwise(zero).alias("Dir_Accuracy_pct"),
        F.when(F.coalesce(sd, F.lit(0.0)) > 0, F.col("_ret.mean") / sd * F.lit(SQRT_252)).otherwise(zero).alias("Sharpe_Ratio"),
        F.coalesce(F.col("drawdown") * 100, zero).alias("Max_Drawdown_pct"),
        round_sig(F.coalesce((F.col("curve_end") - 1) * 100, zero)).alias("Cumulative_Return_pct"))


def rmse_mae(df: DataFrame, y: str = "y", yhat: str = "yhat", keys: Sequence[str] = ("Model",)) -> DataFrame:
    """RMSE and MAE over all horizons flattened (array columns are exploded position-wise)."""
    types = dict(df.dtypes)
    if types[y].startswith("array"):
        df = df.select(*keys, F.explode(F.arrays_zip(F.col(y).alias("y"), F.col(yhat).alias("yhat"))).alias("z")).select(
            *keys, F.col("z.y").alias(y), F.col("z.yhat").alias(yhat))
    e = F.col(y).cast("double") - F.col(yhat).cast("double")
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def rank_models(metrics: DataFrame, metric: str = "RMSE", ascending: bool = True) -> DataFrame:
    """The comparison table in order, with its places; one row per model."""
    by = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(by, "Model"))).orderBy("rank")


def top_models(metrics: DataFrame, k: int = 3, metric: str = "RMSE", keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """The k best models per ticker by ``metric`` (the limit is the feature)."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).asc_nulls_last(), "Model")
    return metrics.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_by(metrics: DataFrame, keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Arg-min RMSE/MAE and arg-max direction/Sharpe/return per ticker."""
    def key(c):  # compare at 10 significant digits, NULL lowest, ties to the larger model name
        return F.struct(F.coalesce(round_sig(F.col(c)), F.lit(-1e308)), F.col("Model"))

    return metrics.groupBy(*keys).agg(
        F.min_by("Model", F.struct(round_sig(F.col("RMSE")), F.col("Model"))).alias("best_rmse_model"),
        F.min_by("Model", F.struct(round_sig(F.col("MAE")), F.col("Model"))).alias("best_mae_model"),
        F.max_by("Model", key("Dir_Accuracy_pct")).alias("best_direction_model"),
        F.max_by("Model", key("Sharpe_Ratio")).alias("best_sharpe_model"),
        F.max_by("Model", key("Total_Return_pct")).alias("best_return_model"))


def inverse_rmse_weights(metrics: DataFrame, keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """(1/rmse) / sum(1/rmse) per key."""
    inv = safe_div(F.lit(1.0), F.col("RMSE"))
    return metrics.select(*keys, "Model", (inv / F.sum(inv).over(Window.partitionBy(*keys))).alias("weight"))


def weighted_ensemble(preds: DataFrame, weights: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """sum(w * yhat) / sum(w) per (Ticker, Timestamp) over the chosen models (renormalised).
    Weights have one row per (Ticker, Model): a small table, broadcast by AQE when it is small."""
    p = preds if models is None else preds.filter(F.col("Model").isin(list(models)))
    j = p.join(weights, ["Ticker", "Model"])
    return j.groupBy("Ticker", "Timestamp").agg(F.first("y").alias("y"),
                                                (F.sum(F.col("weight") * F.col("yhat")) / F.sum("weight")).alias("yhat")
                                                ).withColumn("Model", F.lit("Ensemble_Weighted"))


def residual_quantiles(preds: DataFrame, qs: Sequence[float] = (0.1, 0.5, 0.9), keys=("Model", "Ticker")) -> DataFrame:
    """Exact residual quantiles per model (linear interpolation)."""
    found = exact_quantiles(preds, keys, {"residual": F.col("y") - F.col("yhat")}, qs)
    return found.select(*keys, *[F.col("q")[i].alias(f"q{int(q * 100):02d}") for i, q in enumerate(qs)])


def interval_coverage(df: DataFrame, lo: str = "lo", hi: str = "hi", keys=("Model", "Ticker")) -> DataFrame:
    """Share of actuals inside [lo, hi] (inclusive) and the calibrated flag (75-85%)."""
    cov = F.avg(((F.col("y") >= F.col(lo)) & (F.col("y") <= F.col(hi))).cast("double")) * 100
    a, b = C.CALIBRATED_COVERAGE
    return df.groupBy(*keys).agg(cov.alias("coverage_pct")).withColumn(
        "calibrated", (F.col("coverage_pct") >= a) & (F.col("coverage_pct") <= b))


def interval_and_confidence(pred: Column, rmse: Column, mae: Column, k: float = C.INTERVAL_MULTIPLIER) -> dict:
    """sigma = rmse, else mae, else 0 (a zero falls through); intervals pred -/+ k*sigma;
    confidence = exp(-mean(sigma / max(|pred|, 1)))."""
    sigma = F.coalesce(F.when(rmse != 0, rmse), F.when(mae != 0, mae), F.lit(0.0))
    intervals = F.transform(pred, lambda p: F.array(p - F.lit(k) * sigma, p + F.lit(k) * sigma))
    ratio = F.transform(pred, lambda p: sigma / F.greatest(F.abs(p), F.lit(1.0)))
    mean_ratio = F.aggregate(ratio, F.lit(0.0), lambda a, x: a + x) / F.size(pred)
    return {"sigma": sigma, "intervals": intervals, "confidence": F.exp(-mean_ratio)}


def fold_summary(folds: DataFrame, metrics: Sequence[str] = ("rmse", "mae")) -> DataFrame:
    """Mean and sample std of each metric over the walk-forward folds."""
    return folds.agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics],
                     *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics],
                     F.count(F.lit(1)).alias("n_folds"))
