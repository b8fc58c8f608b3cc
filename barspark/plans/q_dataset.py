"""Dataset queries (J rows, C01-C02). Windows are checked through exact per-window checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import output, round_half_away
from barspark.operators import dataset
from barspark.plans import sql as S
from barspark.plans.q_features import features, package_features_sql
from barspark.plans.q_profile import daily_clean
from barspark.plans.registry import query

FEATS = C.PACKAGE_FEATURES
L = C.SEQUENCE_LENGTH
V = C.VALIDATION_SPLIT
W = 'Ticker ORDER BY "Timestamp"'


def x_checksum(col: str = "X"):
    """Sum of every float in a window times its place (1, 2, ...): steps or features that change places show."""
    weighted = F.transform(F.flatten(col), lambda v, i: v.cast("double") * (i + 1))
    return F.aggregate(weighted, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


X_SUM = "list_sum(list_transform(flatten(X), lambda v, i: CAST(v AS DOUBLE) * i))"


SPLIT_CTES = [
    ("f", package_features_sql("hourly", rounded=False)),
    ("fr", f"""SELECT *, row_number() OVER (PARTITION BY {W}) - 1 AS rn, count(*) OVER (PARTITION BY Ticker) AS n,
        CAST(floor(count(*) OVER (PARTITION BY Ticker) * {1.0 - V!r}) AS BIGINT) AS cutoff FROM f"""),
    ("sp", f"SELECT *, rn < cutoff AS is_train, rn >= greatest({L}, cutoff - {L}) AS is_val FROM fr"),
    ("scaler", " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(CAST({S.q(c)} AS DOUBLE)) AS mean, "
        f"CASE WHEN stddev_pop(CAST({S.q(c)} AS DOUBLE)) = 0 THEN 1.0 ELSE stddev_pop(CAST({S.q(c)} AS DOUBLE)) END AS scale "
        f"FROM sp WHERE is_train" for c in FEATS)),
]
_scaled_list = ", ".join(
    f"CAST((CAST({S.q(c)} AS DOUBLE) - (SELECT mean FROM scaler WHERE feature = '{c}')) / "
    f"(SELECT scale FROM scaler WHERE feature = '{c}') AS FLOAT)" for c in FEATS)
SEQ_CTES = SPLIT_CTES + [
    ("rows", f"SELECT Ticker, \"Timestamp\", rn, n, cutoff, [{_scaled_list}] AS xr, "
             f"[CAST(target_t1 AS FLOAT), CAST(target_t2 AS FLOAT), CAST(target_t3 AS FLOAT)] AS y FROM sp"),
    ("win", f"SELECT *, list(xr) OVER (PARTITION BY {W} ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS X FROM rows"),
    ("ids", "SELECT Ticker, CAST(row_number() OVER (ORDER BY Ticker) - 1 AS INTEGER) AS stock_id FROM (SELECT DISTINCT Ticker FROM f) t"),
    ("seqs", f"""SELECT w.*, 'train' AS split FROM win w WHERE rn - {L - 1} >= 0 AND rn <= cutoff - 1
       UNION ALL SELECT w.*, 'val' AS split FROM win w WHERE rn - {L - 1} >= greatest({L}, cutoff - {L}) AND rn <= n - 1"""),
]


@query("J01_split_train_val", S.with_views('SELECT "Timestamp", Ticker, is_train, is_val FROM sp', SPLIT_CTES))
def q_split(spark, sf_dir):
    d = dataset.split_train_val(features(spark, sf_dir))
    return output(d.select("Timestamp", "Ticker", "is_train", "is_val"))


@query("J02_fit_scaler", S.with_views(f"SELECT feature, {S.r('mean')} AS mean, {S.r('scale')} AS scale FROM scaler", SPLIT_CTES))
def q_scaler(spark, sf_dir):
    d = dataset.split_train_val(features(spark, sf_dir))
    return output(dataset.fit_scaler(d.filter("is_train")))


@query("J03_C02_scaled_features", S.with_views(
    f'SELECT "Timestamp", Ticker, ' + ", ".join(
        f"{S.r(f'(CAST({S.q(c)} AS DOUBLE) - (SELECT mean FROM scaler WHERE feature = {chr(39)}{c}{chr(39)})) / (SELECT scale FROM scaler WHERE feature = {chr(39)}{c}{chr(39)})')} AS {S.q(c)}"
        for c in FEATS) + " FROM sp", SPLIT_CTES))
def q_scaled(spark, sf_dir):
    d = dataset.split_train_val(features(spark, sf_dir))
    sc = dataset.scale(d, dataset.fit_scaler(d.filter("is_train")))
    return output(sc.select("Timestamp", "Ticker", *FEATS))


def _seq_sql(split: str) -> str:
    return S.with_views(f"""
SELECT s.Ticker, i.stock_id, split, s."Timestamp", CAST(len(X) AS INTEGER) AS n_steps,
       {S.r(X_SUM, 2)} AS x_sum,
       {S.r('CAST(y[1] AS DOUBLE)', 4)} AS y1, {S.r('CAST(y[2] AS DOUBLE)', 4)} AS y2, {S.r('CAST(y[3] AS DOUBLE)', 4)} AS y3
FROM seqs s JOIN ids i USING (Ticker) WHERE split = '{split}'""", SEQ_CTES)


def _seq_spark(spark, sf_dir, split):
    win, _, _ = dataset.sequence_dataset(features(spark, sf_dir))
    win = win.filter(F.col("split") == split)
    return output(win.select("Ticker", "stock_id", "split", "Timestamp", F.size("X").alias("n_steps"),
                             round_half_away(x_checksum(), 2).alias("x_sum"), F.col("y")[0].cast("double").alias("y1"),
                             F.col("y")[1].cast("double").alias("y2"), F.col("y")[2].cast("double").alias("y3")), 4)


@query("J05_sequence_dataset_train", _seq_sql("train"))
def q_seq_train(spark, sf_dir):
    """J04/J05 train windows (48 x 24 float32 + 3 targets), one checksum row per window."""
    return _seq_spark(spark, sf_dir, "train")


@query("J05_sequence_dataset_val", _seq_sql("val"))
def q_seq_val(spark, sf_dir):
    return _seq_spark(spark, sf_dir, "val")


@query("J06_latest_sequence", S.with_views(f"""
SELECT Ticker, as_of, n_rows, {S.r(X_SUM, 2)} AS x_sum FROM (
  SELECT Ticker, max("Timestamp") AS as_of, count(*) AS n_rows, list(xr ORDER BY "Timestamp") AS X
  FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY "Timestamp" DESC) AS k FROM rows) t WHERE k <= {L}
  GROUP BY Ticker) z""", SEQ_CTES))
def q_latest_seq(spark, sf_dir):
    f = features(spark, sf_dir)
    scaler = dataset.fit_scaler(dataset.split_train_val(f).filter("is_train"))
    ls = dataset.latest_sequence(f, scaler)
    return output(ls.select("Ticker", "as_of", "n_rows", round_half_away(x_checksum(), 2).alias("x_sum")), 4)


@query("J07_split_3way", S.with_views(f"""
SELECT Ticker, split, count(*) AS n_rows, min("Timestamp") AS first_ts, max("Timestamp") AS last_ts FROM (
  SELECT *, CASE WHEN rn < floor(n * 0.7) THEN 'train' WHEN rn < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {W}) - 1 AS rn, count(*) OVER (PARTITION BY Ticker) AS n FROM cleaned) a) b
GROUP BY 1, 2""", [("bars", S.BARS_DAILY), ("cleaned", S.clean("bars"))]))
def q_split3(spark, sf_dir):
    d = dataset.split_3way(daily_clean(spark, sf_dir))
    return output(d.groupBy("Ticker", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("Timestamp").alias("first_ts"),
                                                 F.max("Timestamp").alias("last_ts")))


@query("J08_horizon_sequences", S.with_views(f"""
SELECT Ticker, "Timestamp", CAST(len(X) AS INTEGER) AS n_steps,
       {S.r(X_SUM, 2)} AS x_sum, {S.r('CAST(y AS DOUBLE)', 2)} AS y FROM (
  SELECT Ticker, "Timestamp", rn, list([CAST("Close" AS FLOAT), CAST("Volume" AS FLOAT)]) OVER (PARTITION BY {W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS X,
         CAST(lead("Close", 1) OVER (PARTITION BY {W}) AS FLOAT) AS y
  FROM (SELECT *, row_number() OVER (PARTITION BY {W}) - 1 AS rn FROM cleaned) a) b
WHERE rn >= 9 AND y IS NOT NULL""", [("bars", S.BARS_DAILY), ("cleaned", S.clean("bars"))]))
def q_horizon(spark, sf_dir):
    """J08 with L=10, h=1, X = (Close, Volume), y = next Close (explicit target)."""
    d = dataset.horizon_sequences(daily_clean(spark, sf_dir), 10, 1, ["Close", "Volume"], "Close")
    return output(d.select("Ticker", "Timestamp", F.size("X").alias("n_steps"), round_half_away(x_checksum(), 2).alias("x_sum"),
                           F.col("y").cast("double").alias("y")), 2)


@query("J09_walk_forward_folds", S.with_views(f"""
SELECT Ticker, fold, role, count(*) AS n_rows, min("Timestamp") AS first_ts, max("Timestamp") AS last_ts FROM (
  SELECT a.*, CAST(g.fold AS INTEGER) AS fold,
         CASE WHEN rn < te + g.fold * step THEN 'train' ELSE 'test' END AS role
  FROM (SELECT *, CAST(floor(n * 0.7) AS BIGINT) AS te,
               CAST(floor((CAST(floor(n * 0.85) AS BIGINT) - CAST(floor(n * 0.7) AS BIGINT)) / 5) AS BIGINT) AS step
        FROM (SELECT *, row_number() OVER (PARTITION BY {W}) - 1 AS rn, count(*) OVER (PARTITION BY Ticker) AS n FROM cleaned) x) a
  JOIN generate_series(0, 4) g(fold) ON a.rn < a.te + (g.fold + 1) * a.step
  WHERE a.step > 0) t
GROUP BY 1, 2, 3""", [("bars", S.BARS_DAILY), ("cleaned", S.clean("bars"))]))
def q_folds(spark, sf_dir):
    d = dataset.walk_forward_folds(daily_clean(spark, sf_dir))
    return output(d.groupBy("Ticker", "fold", "role").agg(F.count(F.lit(1)).alias("n_rows"),
                                                        F.min("Timestamp").alias("first_ts"), F.max("Timestamp").alias("last_ts")))
