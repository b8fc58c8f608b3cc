"""Model fitting and scoring re-aimed at Spark.

Closed-form fits are grouped aggregates (one row of sufficient statistics per series, solved in
column expressions on the executors); iterative fits use Spark ML estimators. Nothing is
collected to the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import safe_div
from barspark.plans import series

# Fixed value: asymptotic 5% critical value of the Dickey-Fuller t statistic, regression with constant.
DF_CRITICAL_5PCT = -2.86


def ar_baseline(bars: DataFrame) -> DataFrame:
    """Per ticker, AR(1) coefficient of Close on its lag and a 0-lag Dickey-Fuller regression
    dC_t = a + b C_{t-1}; t = b / se(b); unit root rejected when t < -2.86."""
    def build(d, w):
        prev = F.lag("Close").over(w)
        return d.withColumns({"_prev": prev, "_dc": F.col("Close") - prev})

    d = series.run_ordered(bars.select("Timestamp", "Ticker", "Close"), build, halo=1)
    g = d.groupBy("Ticker").agg(
        F.regr_slope("Close", "_prev").alias("ar1_phi"), F.regr_intercept("Close", "_prev").alias("ar1_c"),
        F.regr_slope("_dc", "_prev").alias("df_b"), F.regr_intercept("_dc", "_prev").alias("df_a"),
        F.regr_count("_dc", "_prev").alias("n"), F.regr_sxx("_dc", "_prev").alias("_sxx"),
        F.regr_syy("_dc", "_prev").alias("_syy"), F.regr_sxy("_dc", "_prev").alias("_sxy"))
    sse = F.col("_syy") - F.col("df_b") * F.col("_sxy")
    se = F.sqrt(safe_div(safe_div(sse, F.col("n") - 2), F.col("_sxx")))
    return g.withColumn("df_t", safe_div(F.col("df_b"), se)).withColumn(
        "unit_root_rejected", F.col("df_t") < DF_CRITICAL_5PCT).drop("_sxx", "_syy", "_sxy")


def solve_symmetric(matrix: Column, p: int) -> Column:
    """Solution of a positive definite system given as its p rows of p + 1 numbers, the last the right side.

    Elimination pivot by pivot inside one array, without Python; a pivot of 0 (or NULL) gives NULLs."""
    w = p + 1
    at = lambda m, i, j: F.get(m, i * F.lit(w) + j)

    def pivot(m: Column, k: Column) -> Column:
        def cell(x: Column, place: Column) -> Column:
            row, col = F.floor(place / F.lit(w)).cast("int"), F.pmod(place, F.lit(w)).cast("int")
            share = safe_div(at(m, k, col), at(m, k, k))
            return F.when(row == k, share).otherwise(x - at(m, row, k) * share)
        return F.transform(m, cell)

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), matrix, pivot)
    return F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: at(solved, i, F.lit(p)))


def fit_stacking(wide: DataFrame, features: Sequence[str], target: str = "y", alpha: float = 1.0,
                 keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Ridge (intercept not penalised) per key over the predictions of any number of base models.

    One grouped aggregate gives the centred cross products; (X'X + alpha I) w = X'y is solved in
    array expressions, one row per key.
    """
    p, n = len(features), F.count(F.lit(1))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    g = wide.groupBy(*keys).agg(
        F.avg(target).alias("_my"), *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)],
        *[(F.covar_pop(f, target) * n).alias(f"_xy{i}") for i, f in enumerate(features)],
        *[(F.covar_pop(features[i], features[j]) * n).alias(f"_xx{i}_{j}") for i, j in pairs])
    cell = lambda i, j: F.col(f"_xx{min(i, j)}_{max(i, j)}") + F.lit(float(alpha) if i == j else 0.0)
    rows = F.array(*[c for i in range(p) for c in (*(cell(i, j) for j in range(p)), F.col(f"_xy{i}"))])
    out = g.withColumn("_w", solve_symmetric(rows, p))
    weights = [F.get("_w", F.lit(i)) for i in range(p)]
    intercept = F.col("_my") - sum((w * F.col(f"_m{i}") for i, w in enumerate(weights)), F.lit(0.0))
    return out.select(*keys, *[w.alias(f"w_{f}") for f, w in zip(features, weights)], intercept.alias("intercept"))


def apply_stacking(wide: DataFrame, weights: DataFrame, features: Sequence[str], keys: Sequence[str] = ("Ticker",),
                   out: str = "stacked") -> DataFrame:
    """K05 on rows the weights haven't seen: adds the stacked forecast (one row of weights per key)."""
    value = F.col("intercept") + sum((F.col(f"w_{f}") * F.col(f) for f in features), F.lit(0.0))
    return wide.join(weights, list(keys)).withColumn(out, value).drop("intercept", *[f"w_{f}" for f in features])


def seasonal_baseline(train: DataFrame, val: DataFrame) -> DataFrame:
    """Trend (Close on row position) + mean weekday and month residual effects, fitted on
    train, applied to val rows (``_rn`` must be the series position in both)."""
    trend = train.groupBy("Ticker").agg(F.regr_slope("Close", "_rn").alias("b"), F.regr_intercept("Close", "_rn").alias("a"))
    t = train.join(trend, "Ticker").withColumn("_res", F.col("Close") - (F.col("a") + F.col("b") * F.col("_rn")))
    wd = t.groupBy("Ticker", F.weekday("Timestamp").alias("_wd")).agg(F.avg("_res").alias("wd_eff"))
    mo = t.groupBy("Ticker", F.month("Timestamp").alias("_mo")).agg(F.avg("_res").alias("mo_eff"))
    v = (val.withColumns({"_wd": F.weekday("Timestamp"), "_mo": F.month("Timestamp")})
         .join(trend, "Ticker").join(wd, ["Ticker", "_wd"], "left").join(mo, ["Ticker", "_mo"], "left"))
    yhat = F.col("a") + F.col("b") * F.col("_rn") + F.coalesce(F.col("wd_eff"), F.lit(0.0)) + F.coalesce(F.col("mo_eff"), F.lit(0.0))
    return v.select("Ticker", "Timestamp", F.col("Close").alias("y"), yhat.alias("yhat"))


def fit_boosted(train: DataFrame, features: Sequence[str], target: str, val: DataFrame | None = None,
                max_iter: int = 200, max_depth: int = 6, step: float = 0.1, subsample: float = 0.8, seed: int = 42):
    """Gradient-boosted trees with early stopping on a validation set (Spark ML)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    va = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    data = train.withColumn("_is_val", F.lit(False))
    if val is not None:
        data = data.unionByName(val.withColumn("_is_val", F.lit(True)))
    gbt = GBTRegressor(featuresCol="_x", labelCol=target, maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                       subsamplingRate=subsample, seed=seed,
                       validationIndicatorCol="_is_val" if val is not None else None)
    return va, gbt.fit(va.transform(data))


def fit_linear(train: DataFrame, features: Sequence[str], target: str, reg: float = 0.0):
    """K01 (re-aimed): one global linear model over all tickers' rows (ticker identity as a one-hot input)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    stages = [StringIndexer(inputCol="Ticker", outputCol="_tid", handleInvalid="keep"),
              OneHotEncoder(inputCol="_tid", outputCol="_toh"),
              VectorAssembler(inputCols=[*features, "_toh"], outputCol="_x", handleInvalid="keep"),
              LinearRegression(featuresCol="_x", labelCol=target, regParam=reg)]
    return Pipeline(stages=stages).fit(train)


def next_close(bars: DataFrame) -> DataFrame:
    """Bars with ``next_close``, the close of the following bar of the series; the last bar has none and goes."""
    d = series.run_ordered(bars, lambda d, w: d.withColumn("next_close", F.lead("Close").over(w)), halo=0, ahead=1)
    return d.filter(F.col("next_close").isNotNull())


def walk_forward_eval(folded: DataFrame, features: Sequence[str], target: str, naive: str) -> DataFrame:
    """Per fold, least squares on two features fitted on its train rows and scored on its test
    rows, with the errors of the ``naive`` forecast (a column) on the same rows.

    All folds in one job: each fold's sums are one row, solved by Cramer's rule in column
    expressions and joined back to the test rows (folds are a few rows).
    """
    x, z = features
    n = F.count(F.lit(1))
    sums = folded.filter("role = 'train'").groupBy("fold").agg(
        n.alias("train_size"), *[F.avg(c).alias(f"m_{k}") for c, k in ((x, "x"), (z, "z"), (target, "y"))],
        *[F.covar_pop(a, b).alias(k) for a, b, k in ((x, x, "xx"), (z, z, "zz"), (x, z, "xz"), (x, target, "xy"), (z, target, "zy"))])
    c = F.col
    det = c("xx") * c("zz") - c("xz") * c("xz")
    fit = sums.select("fold", "train_size", safe_div(c("xy") * c("zz") - c("zy") * c("xz"), det).alias("_b"),
                      safe_div(c("zy") * c("xx") - c("xy") * c("xz"), det).alias("_d"), "m_x", "m_z", "m_y")
    test = folded.filter("role = 'test'").join(fit, "fold")
    e = c(target) - (c("m_y") + c("_b") * (c(x) - c("m_x")) + c("_d") * (c(z) - c("m_z")))
    ne = c(target) - c(naive)
    return test.groupBy("fold", "train_size").agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(ne * ne)).alias("naive_rmse"),
        F.avg(F.abs(ne)).alias("naive_mae"), n.alias("test_size"))


def fit_horizons(train: DataFrame, feature: str, targets: Sequence[str]) -> DataFrame:
    """One-row table of least-squares lines, one per horizon: slope_i, intercept_i."""
    return train.agg(*[f(t, feature).alias(f"{k}_{i}") for i, t in enumerate(targets)
                       for k, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))])


def predict_horizons(df: DataFrame, lines: DataFrame, feature: str, n: int) -> DataFrame:
    """Adds ``predictions``: one value per horizon (the lines are one row)."""
    d = df.crossJoin(F.broadcast(lines))
    values = F.array(*[F.col(f"intercept_{i}") + F.col(f"slope_{i}") * F.col(feature) for i in range(n)])
    return d.withColumn("predictions", values).drop(*lines.columns)


def score_linear_rows(df: DataFrame, model) -> DataFrame:
    """Batch scoring of a fitted pipeline (executors run the model on their partitions)."""
    return model.transform(df)
