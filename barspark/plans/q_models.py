"""Model queries (K rows). Closed forms carry SQL oracles; Spark ML fits are row-count checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import output
from barspark.operators import dataset, models
from barspark.operators import evaluate as ev
from barspark.plans import sql as S
from barspark.plans.q_evaluate import PRED_CTES, preds
from barspark.plans.q_features import features, package_features_sql
from barspark.plans.q_profile import EDA_CTES, daily_clean
from barspark.plans.registry import query

W = 'PARTITION BY Ticker ORDER BY "Timestamp"'


@query("K07_ar_baseline_unit_root", S.with_views(f"""
SELECT Ticker, {S.r('regr_slope("Close", p)')} AS ar1_phi, {S.r('regr_intercept("Close", p)')} AS ar1_c,
       {S.r('regr_slope(dc, p)')} AS df_b, {S.r('regr_intercept(dc, p)')} AS df_a, regr_count(dc, p) AS n,
       {S.r('regr_slope(dc, p) / sqrt((regr_syy(dc, p) - regr_slope(dc, p) * regr_sxy(dc, p)) / (regr_count(dc, p) - 2) / regr_sxx(dc, p))')} AS df_t,
       regr_slope(dc, p) / sqrt((regr_syy(dc, p) - regr_slope(dc, p) * regr_sxy(dc, p)) / (regr_count(dc, p) - 2) / regr_sxx(dc, p)) < {models.DF_CRITICAL_5PCT} AS unit_root_rejected
FROM (SELECT Ticker, "Close", lag("Close") OVER ({W}) AS p, "Close" - lag("Close") OVER ({W}) AS dc FROM cleaned) x
GROUP BY Ticker""", EDA_CTES[:2]))
def q_ar(spark, sf_dir):
    """Per-ticker AR(1) and Dickey-Fuller (0 lags, constant) regression on the daily closes."""
    return output(models.ar_baseline(daily_clean(spark, sf_dir)))


def _cramer_sql(alpha: float = 1.0, source: str = "wide2", r=S.r) -> str:
    f = ["naive", "sma5", "lag5"]

    def xx(i, j):
        i, j = min(i, j), max(i, j)
        return f"(xx{i}{j} + {alpha})" if i == j else f"xx{i}{j}"

    def det(m):
        (a, b, c), (d, e, g), (h, i_, j) = m
        return f"({a} * ({e} * {j} - {g} * {i_}) - {b} * ({d} * {j} - {g} * {h}) + {c} * ({d} * {i_} - {e} * {h}))"

    A = [[xx(i, j) for j in range(3)] for i in range(3)]
    b = [f"xy{i}" for i in range(3)]
    d = det(A)
    ws = []
    for k in range(3):
        Ak = [[b[r] if c == k else A[r][c] for c in range(3)] for r in range(3)]
        ws.append(f"({det(Ak)} / NULLIF({d}, 0))")
    stats = ", ".join(
        [f"avg(y) AS my"] + [f"avg({x}) AS m{i}" for i, x in enumerate(f)]
        + [f"covar_pop({x}, y) * count(*) AS xy{i}" for i, x in enumerate(f)]
        + [f"covar_pop({a}, {bb}) * count(*) AS xx{i}{j}" for i, a in enumerate(f) for j, bb in enumerate(f) if j >= i])
    inter = f"my - ({ws[0]} * m0 + {ws[1]} * m1 + {ws[2]} * m2)"
    return f"""SELECT Ticker, {r(ws[0])} AS w_naive, {r(ws[1])} AS w_sma5, {r(ws[2])} AS w_lag5, {r(inter)} AS intercept
FROM (SELECT Ticker, {stats} FROM {source} GROUP BY Ticker) s"""


BASE_MODELS = ["naive", "sma5", "lag5"]
WIDE_CTES = PRED_CTES + [
    ("wide2", "SELECT * FROM wide WHERE naive IS NOT NULL AND sma5 IS NOT NULL AND lag5 IS NOT NULL")]


def _wide(spark, sf_dir):
    """One row per bar with the forecast of each base model, where all have one."""
    p = preds(spark, sf_dir)
    wide = p.groupBy("Ticker", "Timestamp").pivot("Model", BASE_MODELS).agg(F.first("yhat")).join(
        p.select("Ticker", "Timestamp", "y").distinct(), ["Ticker", "Timestamp"])
    return wide.na.drop(subset=BASE_MODELS)


@query("K05_stacking_ridge", S.with_views(_cramer_sql(), WIDE_CTES))
def q_stacking(spark, sf_dir):
    """Ridge (alpha=1) meta-learner over the three base forecasts, per ticker, in closed form."""
    return output(models.fit_stacking(_wide(spark, sf_dir), BASE_MODELS, "y", 1.0))


@query("K05_stacking_held_out", S.with_views(f"""
SELECT Ticker, split, count(*) AS n_rows, {S.r('sqrt(avg((y - stacked) * (y - stacked)))', 4)} AS rmse_stacked, {', '.join(
    f"{S.r(f'sqrt(avg((y - {m}) * (y - {m})))', 4)} AS rmse_{m}" for m in BASE_MODELS)}
FROM (SELECT n.*, intercept + w_naive * naive + w_sma5 * sma5 + w_lag5 * lag5 AS stacked FROM numbered n JOIN fitted USING (Ticker)) s
GROUP BY 1, 2""", WIDE_CTES + [
    ("numbered", f"""SELECT *, CASE WHEN rn < floor(n * 0.7) THEN 'train' WHEN rn < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY Ticker) AS n FROM wide2) a"""),
    ("train", "SELECT * FROM numbered WHERE split = 'train'"), ("fitted", _cramer_sql(source="train", r=str))]))
def q_stacking_held_out(spark, sf_dir):
    """The meta-learner fitted on the first 70% of each ticker's bars; its error there, on the next 15% and on
    the last 15%, beside that of each base model on the same rows."""
    d = dataset.split_3way(_wide(spark, sf_dir))
    weights = models.fit_stacking(d.filter("split = 'train'"), BASE_MODELS, "y", 1.0)
    scored = models.apply_stacking(d, weights, BASE_MODELS)
    rmse = lambda m: F.sqrt(F.avg((F.col("y") - F.col(m)) ** 2)).alias(f"rmse_{m}")
    return output(scored.groupBy("Ticker", "split").agg(F.count(F.lit(1)).alias("n_rows"), rmse("stacked"),
                                                        *[rmse(m) for m in BASE_MODELS]), 4)


@query("K08_seasonal_baseline", S.with_views(f"""
SELECT v.Ticker, v."Timestamp", {S.r('v."Close"')} AS y,
       {S.r('t.a + t.b * v.rn + coalesce(wd.e, 0.0) + coalesce(mo.e, 0.0)')} AS yhat
FROM s v JOIN tr t USING (Ticker)
LEFT JOIN (SELECT Ticker, isodow("Timestamp") - 1 AS d, avg(res) AS e FROM r GROUP BY 1, 2) wd ON wd.Ticker = v.Ticker AND wd.d = isodow(v."Timestamp") - 1
LEFT JOIN (SELECT Ticker, month("Timestamp") AS m, avg(res) AS e FROM r GROUP BY 1, 2) mo ON mo.Ticker = v.Ticker AND mo.m = month(v."Timestamp")
WHERE v.split = 'val'""", EDA_CTES[:2] + [
    ("s", f"""SELECT *, CASE WHEN rn < floor(n * 0.7) THEN 'train' WHEN rn < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY Ticker) AS n FROM cleaned) a"""),
    ("tr", "SELECT Ticker, regr_slope(\"Close\", rn) AS b, regr_intercept(\"Close\", rn) AS a FROM s WHERE split = 'train' GROUP BY Ticker"),
    ("r", "SELECT s.*, s.\"Close\" - (t.a + t.b * s.rn) AS res FROM s JOIN tr t USING (Ticker) WHERE split = 'train'")]))
def q_seasonal_baseline(spark, sf_dir):
    """Trend + weekday + month effects fitted on the 70% train split, forecasts for the 15% val split."""
    d = dataset.split_3way(daily_clean(spark, sf_dir))
    out = models.seasonal_baseline(d.filter("split = 'train'"), d.filter("split = 'val'"))
    return output(out)


@query("K01_K04_global_linear_forecaster")
def q_global_linear(spark, sf_dir):
    """One linear model over all tickers (ticker one-hot + 24 features) for target_t1, fitted on the
    train split and batch-scored on the val rows. Checked by row count (no SQL twin)."""
    from barspark.plans.q_features import features
    f = dataset.split_train_val(features(spark, sf_dir))
    model = models.fit_linear(f.filter("is_train"), C.PACKAGE_FEATURES, "target_t1")
    scored = models.score_linear_rows(f.filter("is_val"), model)
    return output(scored.select("Ticker", "Timestamp", F.col("target_t1").alias("y"), F.col("prediction").alias("yhat")))


# Next close from the close and the bar's body, both known when the bar ends.
FOLD_CTES = [("bars", S.BARS_DAILY), ("cleaned", S.clean("bars")),
    ("nx", f"""SELECT * FROM (SELECT *, lead("Close") OVER ({W}) AS nc, "Close" - "Open" AS oc FROM cleaned) a WHERE nc IS NOT NULL"""),
    ("fold_rows", f"""SELECT a.*, g.fold, rn < te + g.fold * step AS is_train
  FROM (SELECT *, CAST(floor(n * 0.7) AS BIGINT) AS te, CAST(floor((CAST(floor(n * 0.85) AS BIGINT) - CAST(floor(n * 0.7) AS BIGINT)) / 5) AS BIGINT) AS step
        FROM (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY Ticker) AS n FROM nx) x) a
  JOIN generate_series(0, 4) g(fold) ON a.rn < a.te + (g.fold + 1) * a.step WHERE a.step > 0"""),
    ("sums", """SELECT fold, count(*) AS train_size, avg("Close") AS mx, avg(oc) AS mz, avg(nc) AS my, var_pop("Close") AS xx, var_pop(oc) AS zz,
  covar_pop("Close", oc) AS xz, covar_pop("Close", nc) AS xy, covar_pop(oc, nc) AS zy FROM fold_rows WHERE is_train GROUP BY fold"""),
    ("errors", """SELECT CAST(fold AS INTEGER) AS fold, train_size, nc - "Close" AS ne,
  nc - (my + (xy * zz - zy * xz) / (xx * zz - xz * xz) * ("Close" - mx) + (zy * xx - xy * xz) / (xx * zz - xz * xz) * (oc - mz)) AS e
  FROM fold_rows JOIN sums USING (fold) WHERE NOT is_train"""),
    ("scores", """SELECT fold, train_size, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, sqrt(avg(ne * ne)) AS naive_rmse, avg(abs(ne)) AS naive_mae,
  count(*) AS test_size FROM errors GROUP BY fold, train_size""")]
SCORES = ["rmse", "mae", "naive_rmse", "naive_mae"]


def _walk_forward(spark, sf_dir):
    d = models.next_close(daily_clean(spark, sf_dir)).withColumn("oc", F.col("Close") - F.col("Open"))
    return models.walk_forward_eval(dataset.walk_forward_folds(d), ["Close", "oc"], "next_close", naive="Close")


@query("K06_walk_forward_eval", S.with_views(f"SELECT fold, train_size, test_size, {S.rcols(SCORES, 4)} FROM scores", FOLD_CTES))
def q_walk_forward(spark, sf_dir):
    """Expanding walk-forward folds on the daily series; next close by least squares, against the naive forecast."""
    return output(_walk_forward(spark, sf_dir).select("fold", "train_size", "test_size", *SCORES), 4)


@query("K02_boosted_trees")
def q_boosted(spark, sf_dir):
    """Gradient-boosted trees (depth 6, step 0.1, subsample 0.8, seed 42, up to 200 rounds with
    validation early stopping) on the notebook features predicting the next return; val predictions."""
    from barspark.operators.cleaning import numeric_features
    from barspark.plans.q_notebook import nb_features
    nb = dataset.split_3way(nb_features(spark, sf_dir, "daily")).filter(F.col("Target_Return").isNotNull())
    feats = [c for c in numeric_features(nb) if c not in ("_n",)]
    va, model = models.fit_boosted(nb.filter("split = 'train'"), feats, "Target_Return", nb.filter("split = 'val'"))
    pred = model.transform(va.transform(nb.filter("split = 'test'")))
    return output(pred.select("Ticker", "Timestamp", F.col("Target_Return").alias("y"), F.col("prediction").alias("yhat")))


REQUESTS = [("req", """SELECT upper(ticker) AS Ticker, as_of FROM (
  SELECT lower(t) AS ticker, TIMESTAMP '2024-01-20 10:00:00' AS as_of FROM (SELECT DISTINCT Ticker AS t FROM bars) a
  UNION ALL SELECT min(Ticker), NULL FROM bars UNION ALL SELECT 'ZZZZ.NS', NULL
  UNION ALL SELECT DISTINCT Ticker, TIMESTAMP '2024-01-20 10:00:00' FROM bars WHERE Ticker LIKE '%.NS'
  UNION ALL SELECT DISTINCT Ticker, TIMESTAMP '2024-01-01 00:00:00' FROM bars) r""")]
HORIZONS = range(1, C.HORIZON + 1)
L, H = 40, C.HORIZON  # feature rows a request needs
_lines = ", ".join(f'regr_slope(target_t{h}, "Close") AS s{h}, regr_intercept(target_t{h}, "Close") AS i{h}' for h in HORIZONS)
_errors = ", ".join(f'target_t{h} - (i{h} + s{h} * "Close")' for h in HORIZONS)
PREDICT_CTES = [("bars", S.BARS_HOURLY), *REQUESTS,
    ("ff", package_features_sql("hourly", rounded=False)), ("fa", package_features_sql("hourly", drop_nulls=False, rounded=False)),
    ("sp", f"""SELECT *, rn < cutoff AS is_train, rn >= greatest({C.SEQUENCE_LENGTH}, cutoff - {C.SEQUENCE_LENGTH}) AS is_val FROM (
      SELECT *, row_number() OVER ({W}) - 1 AS rn, CAST(floor(count(*) OVER (PARTITION BY Ticker) * {1.0 - C.VALIDATION_SPLIT!r}) AS BIGINT) AS cutoff FROM ff) x"""),
    ("lines", f"SELECT {_lines} FROM sp WHERE is_train"),
    ("sigma", f"SELECT sqrt(avg(e * e)) AS s FROM (SELECT unnest([{_errors}]) AS e FROM sp, lines WHERE is_val) x"),
    ("numbered", "SELECT *, row_number() OVER (PARTITION BY Ticker, as_of ORDER BY 1) AS request FROM req"),
    ("usable", f"""SELECT * FROM fa WHERE {' AND '.join(f'{S.q(c)} IS NOT NULL' for c in C.PACKAGE_FEATURES)}"""),
    ("ranked", """SELECT r.Ticker, r.as_of, r.request, u."Timestamp", u."Close", row_number() OVER (PARTITION BY r.Ticker, r.as_of, r.request ORDER BY u."Timestamp" DESC) AS k,
      count(*) OVER (PARTITION BY r.Ticker, r.as_of, r.request) AS n FROM numbered r JOIN usable u ON u.Ticker = r.Ticker AND (r.as_of IS NULL OR u."Timestamp" <= r.as_of)"""),
    ("answered", f"""SELECT Ticker, as_of, request, "Timestamp", {', '.join(f'i{h} + s{h} * "Close" AS p{h}' for h in HORIZONS)}, s FROM ranked, lines, sigma WHERE k = {H + 1} AND n >= {L + H}"""),
]
_out = ", ".join(f"{S.r(f'p{h}', 4)} AS p{h}, {S.r(f'p{h} - 1.96 * s', 4)} AS lo{h}, {S.r(f'p{h} + 1.96 * s', 4)} AS hi{h}" for h in HORIZONS)
_ratio = " + ".join(f"s / greatest(abs(p{h}), 1.0)" for h in HORIZONS)
_none = ", ".join(f"NULL AS {k}{h}" for h in HORIZONS for k in ("p", "lo", "hi"))


@query("L20_predict_batch", S.with_views(f"""
SELECT Ticker AS ticker, as_of, NULL AS reason, "Timestamp" AS feature_ts, {_out}, {S.r(f'exp(-({_ratio}) / {H})', 4)} AS confidence FROM answered
UNION ALL SELECT r.Ticker, r.as_of, CASE WHEN r.Ticker IN (SELECT Ticker FROM fa) THEN 'fewer than {L} feature rows' ELSE 'unknown ticker' END, NULL, {_none}, NULL
FROM numbered r LEFT JOIN answered a ON a.Ticker = r.Ticker AND a.as_of IS NOT DISTINCT FROM r.as_of AND a.request = r.request WHERE a.Ticker IS NULL""", PREDICT_CTES))
def q_predict_batch(spark, sf_dir):
    """Batch of requests (as of a cutoff, latest, repeated, too early, unknown), each answered with three
    predictions and intervals or rejected with a reason; one line per horizon, sigma over all horizons."""
    from barspark.operators import cleaning, indicators, serving
    from barspark.sources import fixtures as fx
    bars = fx.bars_hourly(spark, sf_dir)
    feats = indicators.feature_frame(cleaning.clean_market_data(bars), drop_nulls=False)
    split = dataset.split_train_val(feats.na.drop(how="any"))
    targets = [f"target_t{h}" for h in HORIZONS]
    lines = models.fit_horizons(split.filter("is_train"), "Close", targets)
    predict = lambda df: models.predict_horizons(df, lines, "Close", len(targets))
    val = predict(split.filter("is_val")).select(F.lit("all").alias("Model"), F.array(*targets).alias("y"), F.col("predictions").alias("yhat"))
    tickers = bars.select("Ticker").distinct()
    stamp = lambda s: F.lit(s).cast("timestamp").alias("as_of")
    req = cleaning.normalize_ticker(fx.requests(spark, sf_dir).withColumnRenamed("ticker", "Ticker"))
    req = (req.unionByName(tickers.filter(F.col("Ticker").endswith(".NS")).select("Ticker", stamp("2024-01-20 10:00:00")))
           .unionByName(tickers.select("Ticker", stamp("2024-01-01 00:00:00"))))
    resp, rejected = serving.predict_batch(req, feats, predict, ev.rmse_mae(val), C.PACKAGE_FEATURES, seq_len=L)
    cols = [c for h in HORIZONS for c in (F.col("predictions")[h - 1].alias(f"p{h}"), F.col("intervals")[h - 1][0].alias(f"lo{h}"),
                                          F.col("intervals")[h - 1][1].alias(f"hi{h}"))]
    out = resp.select("ticker", "as_of", F.lit(None).cast("string").alias("reason"), "feature_ts", *cols, "confidence")
    return output(out.unionByName(rejected.select(F.col("Ticker").alias("ticker"), "as_of", "reason"), allowMissingColumns=True), 4)


@query("D26_fold_summary", S.with_views(
    "SELECT " + ", ".join(f"{S.r(f'avg({m})', 4)} AS {m}_mean, {S.r(f'stddev_samp({m})', 4)} AS {m}_std" for m in SCORES) + ", count(*) AS n_folds FROM scores", FOLD_CTES))
def q_fold_summary(spark, sf_dir):
    """Mean and std of the walk-forward fold scores, of the model and of the naive forecast."""
    return output(ev.fold_summary(_walk_forward(spark, sf_dir), SCORES), 4)


@query("K01_K04_horizon_lines", S.with_views(f"""
SELECT Ticker, "Timestamp", {', '.join(f'{S.r(f"target_t{h}", 4)} AS y{h}, {S.r(f"i{h} + s{h} * {S.q("Close")}", 4)} AS p{h}' for h in HORIZONS)}
FROM sp, lines WHERE is_val""", PREDICT_CTES))
def q_horizon_lines(spark, sf_dir):
    """All three horizons fitted on the train rows of all tickers; val rows scored in tasks, the
    model built once per partition from its six numbers."""
    from barspark.operators import serving

    f = dataset.split_train_val(features(spark, sf_dir))
    targets = [f"target_t{h}" for h in HORIZONS]
    row = models.fit_horizons(f.filter("is_train"), "Close", targets).first()
    lines = [(row[f"intercept_{i}"], row[f"slope_{i}"]) for i in range(len(targets))]

    def make_model():
        return lambda pdf: pdf["Close"].map(lambda x: [a + b * x for a, b in lines])

    scored = serving.score_batch(f.filter("is_val").select("Ticker", "Timestamp", "Close", *targets), make_model)
    cols = [c for i, t in enumerate(targets) for c in (F.col(t).alias(f"y{i + 1}"), F.col("predictions")[i].alias(f"p{i + 1}"))]
    return output(scored.select("Ticker", "Timestamp", *cols), 4)
