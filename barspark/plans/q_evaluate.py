"""Evaluation / backtest / ensemble queries (L rows, H03-H05, K03)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import output
from barspark.operators import dataset
from barspark.operators import evaluate as ev
from barspark.plans import sql as S
from barspark.plans.q_features import features
from barspark.plans.q_profile import daily_clean
from barspark.plans.registry import query
from barspark.plans.series import RN

WM = 'PARTITION BY Model, Ticker ORDER BY "Timestamp"'
SQRT252 = repr(math.sqrt(C.TRADING_DAYS))


def preds(spark, sf_dir):
    return ev.naive_predictions(daily_clean(spark, sf_dir))


PRED_CTES = [
    ("bars", S.BARS_DAILY), ("cleaned", S.clean("bars")),
    ("wide", f"""SELECT Ticker, "Timestamp", "Close" AS y, lag("Close", 1) OVER w AS naive,
       CASE WHEN count("Close") OVER w5 = 5 THEN list_sum(list("Close") OVER w5) / 5 END AS sma5,
       lag("Close", 5) OVER w AS lag5
FROM cleaned WINDOW w AS (PARTITION BY Ticker ORDER BY "Timestamp"),
                    w5 AS (PARTITION BY Ticker ORDER BY "Timestamp" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""),
    ("preds", """SELECT Model, Ticker, "Timestamp", y, yhat FROM wide UNPIVOT (yhat FOR Model IN (naive, sma5, lag5))"""),
    ("st", f"""SELECT *, row_number() OVER ({WM}) - 1 AS rn, y - lag(y) OVER ({WM}) AS dy, yhat - lag(yhat) OVER ({WM}) AS dp,
       (y - lag(y) OVER ({WM})) / NULLIF(lag(y) OVER ({WM}), 0) AS r,
       (y > lag(y) OVER ({WM})) = (yhat > lag(yhat) OVER ({WM})) AS up_eq FROM preds"""),
    ("st2", "SELECT *, CAST(sign(dp) AS DOUBLE) AS sig, CASE WHEN dp IS NULL THEN NULL WHEN dp > 0 THEN r ELSE 0.0 END AS ret_b FROM st"),
    ("st3", f"""SELECT *, abs(sig - lag(sig) OVER ({WM})) AS trade, r * sig AS strat,
       CAST(CAST(sign(dy) AS DOUBLE) = sig AS DOUBLE) AS dir_a FROM st2"""),
]

VAL_CTES = PRED_CTES + [
    ("per", "SELECT Model, Ticker, count(*) AS n, sum(trade) AS trades, avg(y) AS ybar FROM st3 GROUP BY 1, 2"),
    ("v1", f"SELECT s.*, p.n, p.trades, p.ybar, strat - {C.TRANSACTION_COST} * coalesce(p.trades, 0) / (p.n - 1) AS net FROM st3 s JOIN per p USING (Model, Ticker)"),
    ("v2", f"SELECT *, CASE WHEN net IS NULL THEN NULL ELSE product(1 + net) OVER ({WM} ROWS UNBOUNDED PRECEDING) END AS cum FROM v1"),
    ("v3", f"SELECT *, CASE WHEN cum IS NULL THEN NULL ELSE max(cum) OVER ({WM} ROWS UNBOUNDED PRECEDING) END AS cmax, net - {C.RISK_FREE_RATE / C.TRADING_DAYS!r} AS ex FROM v2"),
    ("vm", f"""SELECT Model, Ticker, sqrt(avg((y - yhat) * (y - yhat))) AS "RMSE", avg(abs(y - yhat)) AS "MAE",
       avg(abs((y - yhat) / NULLIF(y, 0))) * 100 AS "MAPE",
       1.0 - sum((y - yhat) * (y - yhat)) / NULLIF(sum((y - ybar) * (y - ybar)), 0) AS "R2",
       avg(dir_a) * 100 AS "Dir_Accuracy_pct",
       CASE WHEN stddev_samp(ex) = 0 THEN 0.0 ELSE {SQRT252} * avg(ex) / stddev_samp(ex) END AS "Sharpe_Ratio",
       min((cum - cmax) / NULLIF(cmax, 0)) * 100 AS "Max_Drawdown_pct",
       {S.rsig('(arg_max(cum, rn) - 1) * 100')} AS "Total_Return_pct", coalesce(sum(trade), CASE WHEN count(y - yhat) > 0 THEN 0.0 END) AS "Num_Trades"
FROM v3 GROUP BY Model, Ticker"""),
]
VAL_COLS = ["RMSE", "MAE", "MAPE", "R2", "Dir_Accuracy_pct", "Sharpe_Ratio", "Max_Drawdown_pct", "Total_Return_pct", "Num_Trades"]


@query("L_preds_fixture", S.with_views(f'SELECT Model, Ticker, "Timestamp", {S.rcols(["y", "yhat"])} FROM preds', PRED_CTES))
def q_preds(spark, sf_dir):
    """The long prediction table every L query evaluates (three deterministic forecasters)."""
    return output(preds(spark, sf_dir))


@query("L12_L14_validation_metrics", S.with_views(f"SELECT Model, Ticker, {S.rcols(VAL_COLS)} FROM vm", VAL_CTES))
def q_val_metrics(spark, sf_dir):
    """RMSE, MAE, MAPE, R2, sign direction, long/short backtest with costs, Sharpe,
    drawdown, total return and trades for every (model, ticker) in one job."""
    return output(ev.validation_metrics(preds(spark, sf_dir)))


TEST_CTES = PRED_CTES + [
    ("t2", f"SELECT *, CASE WHEN ret_b IS NULL THEN NULL ELSE product(1 + ret_b) OVER ({WM} ROWS UNBOUNDED PRECEDING) END AS cum FROM st3"),
    ("t3", f"SELECT *, CASE WHEN cum IS NULL THEN NULL ELSE max(cum) OVER ({WM} ROWS UNBOUNDED PRECEDING) END AS cmax FROM t2"),
    ("tm", f"""SELECT Model, Ticker, sqrt(avg((y - yhat) * (y - yhat))) AS "RMSE", avg(abs(y - yhat)) AS "MAE",
       avg(abs((y - yhat) / (y + {C.MAPE_EPSILON!r}))) * 100 AS "MAPE_pct",
       CASE WHEN count(*) > 1 THEN avg(CASE WHEN dp IS NOT NULL THEN CAST(up_eq AS DOUBLE) END) * 100 WHEN count(y - yhat) > 0 THEN 0.0 END AS "Dir_Accuracy_pct",
       CASE WHEN coalesce(stddev_pop(ret_b), 0) > 0 THEN avg(ret_b) / stddev_pop(ret_b) * {SQRT252}
            WHEN count(y - yhat) > 0 THEN 0.0 END AS "Sharpe_Ratio",
       coalesce(min((cum - cmax) / NULLIF(cmax, 0)) * 100, CASE WHEN count(y - yhat) > 0 THEN 0.0 END) AS "Max_Drawdown_pct",
       {S.rsig('coalesce((arg_max(cum, CASE WHEN cum IS NOT NULL THEN rn END) - 1) * 100, CASE WHEN count(y - yhat) > 0 THEN 0.0 END)')} AS "Cumulative_Return_pct"
FROM t3 GROUP BY Model, Ticker"""),
]
TEST_COLS = ["RMSE", "MAE", "MAPE_pct", "Dir_Accuracy_pct", "Sharpe_Ratio", "Max_Drawdown_pct", "Cumulative_Return_pct"]


@query("L13_test_metrics", S.with_views(f"SELECT Model, Ticker, {S.rcols(TEST_COLS)} FROM tm", TEST_CTES))
def q_test_metrics(spark, sf_dir):
    """The test-set flavour (long/cash strategy, population std)."""
    return output(ev.test_metrics(preds(spark, sf_dir)))


@query("H04_top_models", S.with_views(f"""
SELECT Model, Ticker, {S.rcols(VAL_COLS)}, CAST(rk AS INTEGER) AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY "RMSE" NULLS LAST, Model) AS rk FROM vm) t WHERE rk <= 2""", VAL_CTES))
def q_top_models(spark, sf_dir):
    """Models ranked by RMSE per ticker, best 2 kept."""
    return output(ev.top_models(ev.validation_metrics(preds(spark, sf_dir)), k=2))


@query("H05_L21_best_by", S.with_views(f"""
SELECT Ticker, arg_min(Model, ({S.rsig('"RMSE"')}, Model)) AS best_rmse_model, arg_min(Model, ({S.rsig('"MAE"')}, Model)) AS best_mae_model,
       arg_max(Model, (coalesce({S.rsig('"Dir_Accuracy_pct"')}, -1e308), Model)) AS best_direction_model,
       arg_max(Model, (coalesce({S.rsig('"Sharpe_Ratio"')}, -1e308), Model)) AS best_sharpe_model,
       arg_max(Model, (coalesce({S.rsig('"Total_Return_pct"')}, -1e308), Model)) AS best_return_model
FROM vm GROUP BY Ticker""", VAL_CTES))
def q_best_by(spark, sf_dir):
    return output(ev.best_by(ev.validation_metrics(preds(spark, sf_dir))))


@query("L15_inverse_rmse_weights", S.with_views(f"""
SELECT Ticker, Model, {S.r('(1.0 / NULLIF("RMSE", 0)) / sum(1.0 / NULLIF("RMSE", 0)) OVER (PARTITION BY Ticker)')} AS weight FROM vm""", VAL_CTES))
def q_weights(spark, sf_dir):
    return output(ev.inverse_rmse_weights(ev.validation_metrics(preds(spark, sf_dir))))


@query("L16_weighted_ensemble", S.with_views(f"""
SELECT p.Ticker, p."Timestamp", {S.r('any_value(p.y)')} AS y, {S.r('sum(w.weight * p.yhat) / sum(w.weight)')} AS yhat,
       'Ensemble_Weighted' AS Model
FROM preds p JOIN (SELECT Ticker, Model, (1.0 / NULLIF("RMSE", 0)) / sum(1.0 / NULLIF("RMSE", 0)) OVER (PARTITION BY Ticker) AS weight FROM vm) w
  ON p.Ticker = w.Ticker AND p.Model = w.Model
WHERE p.Model IN ('naive', 'sma5') GROUP BY p.Ticker, p."Timestamp\"""", VAL_CTES))
def q_ensemble(spark, sf_dir):
    """Weighted ensemble of a model subset (weights from all models, renormalised over the subset)."""
    p = preds(spark, sf_dir)
    w = ev.inverse_rmse_weights(ev.validation_metrics(p))
    return output(ev.weighted_ensemble(p, w, ["naive", "sma5"]))


@query("K03_L17_residual_interval_coverage", S.with_views(f"""
SELECT p.Model, p.Ticker, {S.r('q.q10')} AS q10, {S.r('q.q50')} AS q50, {S.r('q.q90')} AS q90,
       {S.r('avg(CAST(p.y >= p.yhat + q.q10 AND p.y <= p.yhat + q.q90 AS DOUBLE)) * 100')} AS coverage_pct,
       avg(CAST(p.y >= p.yhat + q.q10 AND p.y <= p.yhat + q.q90 AS DOUBLE)) * 100 BETWEEN {C.CALIBRATED_COVERAGE[0]} AND {C.CALIBRATED_COVERAGE[1]} AS calibrated
FROM parted p JOIN (SELECT Model, Ticker, quantile_cont(y - yhat, 0.1) AS q10, quantile_cont(y - yhat, 0.5) AS q50,
                          quantile_cont(y - yhat, 0.9) AS q90 FROM parted WHERE is_train GROUP BY 1, 2) q USING (Model, Ticker)
WHERE NOT p.is_train GROUP BY p.Model, p.Ticker, q.q10, q.q50, q.q90""", PRED_CTES + [
    ("parted", f"SELECT *, row_number() OVER ({WM}) - 1 < floor(count(*) OVER (PARTITION BY Model, Ticker) * 0.7) AS is_train FROM preds")]))
def q_quantiles(spark, sf_dir):
    """K03 residual quantiles fitted on the first 70 % of each series, L17 coverage of
    [yhat+q10, yhat+q90] on the later rows, which the quantiles have not seen."""
    p = dataset.with_counts(preds(spark, sf_dir), keys=("Model", "Ticker"))
    train = F.col(RN) < F.floor(F.col("_n") * 0.7)
    q = ev.residual_quantiles(p.filter(train))
    iv = p.filter(~train).join(q, ["Model", "Ticker"]).withColumns({"lo": F.col("yhat") + F.col("q10"), "hi": F.col("yhat") + F.col("q90")})
    cov = ev.interval_coverage(iv)
    return output(q.join(cov, ["Model", "Ticker"]).select("Model", "Ticker", "q10", "q50", "q90", "coverage_pct", "calibrated"))


@query("L18_L19_interval_confidence", S.with_views(f"""
SELECT Model, Ticker, {S.r('sigma')} AS sigma,
       {', '.join(f"{S.r(f'p[{i}] - 1.96 * sigma')} AS lo_{i}, {S.r(f'p[{i}] + 1.96 * sigma')} AS hi_{i}" for i in (1, 2, 3))},
       {S.r('exp(-((sigma / greatest(abs(p[1]), 1.0)) + (sigma / greatest(abs(p[2]), 1.0)) + (sigma / greatest(abs(p[3]), 1.0))) / 3)')} AS confidence
FROM (SELECT l.Model, l.Ticker, l.p, coalesce(CASE WHEN m."RMSE" <> 0 THEN m."RMSE" END, CASE WHEN m."MAE" <> 0 THEN m."MAE" END, 0.0) AS sigma
      FROM (SELECT Model, Ticker, list(yhat ORDER BY "Timestamp") AS p FROM
             (SELECT *, row_number() OVER (PARTITION BY Model, Ticker ORDER BY "Timestamp" DESC) AS k FROM preds) z
            WHERE k <= 3 GROUP BY 1, 2) l JOIN vm m USING (Model, Ticker)) x""", VAL_CTES))
def q_interval(spark, sf_dir):
    """A 3-step forecast vector per (model, ticker) = its 3 latest predictions, sigma from
    the stored metrics (RMSE, else MAE, else 0), 1.96-sigma intervals and exp(-mean ratio) confidence."""
    p = preds(spark, sf_dir)
    m = ev.validation_metrics(p)
    from barspark.plans.series import latest_n
    last = latest_n(p, 3, keys=("Model", "Ticker"))
    vec = last.groupBy("Model", "Ticker").agg(F.sort_array(F.collect_list(F.struct("Timestamp", "yhat"))).alias("_r"))
    vec = vec.select("Model", "Ticker", F.transform("_r", lambda r: r["yhat"]).alias("pred")).join(m, ["Model", "Ticker"])
    ic = ev.interval_and_confidence(F.col("pred"), F.col("RMSE"), F.col("MAE"))
    out = vec.select("Model", "Ticker", ic["sigma"].alias("sigma"), ic["intervals"].alias("iv"), ic["confidence"].alias("confidence"))
    cols = [F.col("iv")[i - 1][j].alias(f"{nm}_{i}") for i in (1, 2, 3) for j, nm in ((0, "lo"), (1, "hi"))]
    return output(out.select("Model", "Ticker", "sigma", *cols, "confidence"))


@query("L01_rmse_mae_horizons", S.with_views(f"""
SELECT Ticker, {S.r('sqrt(avg(e * e))')} AS rmse, {S.r('avg(abs(e))')} AS mae FROM (
  SELECT Ticker, unnest([target_t1 - "Close", target_t2 - "Close", target_t3 - "Close"]) AS e FROM f) x GROUP BY Ticker""",
    [("f", __import__("barspark.plans.q_features", fromlist=["x"]).package_features_sql("hourly", rounded=False))]))
def q_rmse_mae(spark, sf_dir):
    """Persistence forecast (Close for all 3 horizons) against target_t1..3, flattened."""
    f = features(spark, sf_dir)
    d = f.select("Ticker", F.array("target_t1", "target_t2", "target_t3").alias("y"),
                 F.array("Close", "Close", "Close").alias("yhat"))
    return output(ev.rmse_mae(d, keys=("Ticker",)))
