"""Persisted tables, reports, alignment, fill and column-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import output
from barspark.operators import cleaning, dataset, market, notebook, serving
from barspark.operators import evaluate as ev
from barspark.plans import pipeline, series
from barspark.plans import sql as S
from barspark.plans.q_dataset import FEATS, SPLIT_CTES
from barspark.plans.q_evaluate import PRED_CTES, preds
from barspark.plans.q_features import features, package_features_sql
from barspark.plans.registry import query
from barspark.schema import validate_bars, validate_features
from barspark.sources import bars_io as io
from barspark.sources import fixtures as fx

BAR_OUT = '"Timestamp", Ticker, ' + S.rcols(C.PRICE_COLUMNS)
FEATURE_CTES = [("f", package_features_sql("hourly", rounded=False))]


@query("A06_report_round_trip", S.with_views(
    f'SELECT Ticker, count(*) AS n_bars, {S.r("avg(\"Close\")")} AS mean_close, {S.r("max(\"Close\")")} AS top_close FROM bars GROUP BY Ticker',
    [("bars", S.BARS_DAILY)]))
def q_report(spark, sf_dir):
    """JSON report with a nested struct per ticker, written and read back."""
    b = fx.bars_daily(spark, sf_dir).groupBy("Ticker").agg(
        F.count(F.lit(1)).alias("n_bars"), F.struct(F.avg("Close").alias("mean"), F.max("Close").alias("top")).alias("close"))
    path = io.write_report(b, io.scratch_path(spark, "report"))
    back = spark.read.schema(b.schema).json(path)
    return output(back.select("Ticker", "n_bars", F.col("close.mean").alias("mean_close"), F.col("close.top").alias("top_close")))


@query("A07_scaler_round_trip", S.with_views(f"SELECT feature, {S.r('mean')} AS mean, {S.r('scale')} AS scale FROM scaler", SPLIT_CTES))
def q_scaler_file(spark, sf_dir):
    """Scaler table fitted on the train rows, saved and loaded."""
    fitted = dataset.fit_scaler(dataset.split_train_val(features(spark, sf_dir)).filter("is_train"))
    return output(io.load_scaler(spark, io.save_scaler(fitted, io.scratch_path(spark, "scaler"))))


FEATURE_VALUES = ", ".join(f"('{c}', {i})" for i, c in enumerate(FEATS))


@query("A13_model_metadata", S.with_views(f"""
SELECT 'v1' AS model_version, * FROM (
  SELECT 'setting' AS kind, name, value FROM (VALUES ('input_dim', {len(FEATS)}.0), ('sequence_length', {C.SEQUENCE_LENGTH}.0), ('output_dim', {C.HORIZON}.0)) s(name, value)
  UNION ALL SELECT 'feature', name, CAST(position AS DOUBLE) FROM (VALUES {FEATURE_VALUES}) v(name, position)
  UNION ALL SELECT 'stock', Ticker, CAST(row_number() OVER (ORDER BY Ticker) - 1 AS DOUBLE) FROM (SELECT DISTINCT Ticker FROM f) t
  UNION ALL SELECT 'metric', 'rmse', {S.r('sqrt(avg(power(target_t1 - "Close", 2)))')} FROM f
  UNION ALL SELECT 'metric', 'mae', {S.r('avg(abs(target_t1 - "Close"))')} FROM f) m""", FEATURE_CTES))
def q_metadata(spark, sf_dir):
    """Settings, feature positions, stock ids and metrics of a model, one row each."""
    from barspark.operators.profile import stock_ids
    f = features(spark, sf_dir)
    e = F.col("target_t1") - F.col("Close")
    metrics = f.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")).select(
        F.explode(F.create_map(F.lit("rmse"), "rmse", F.lit("mae"), "mae")).alias("metric", "value"))
    names = f.limit(1).select(F.posexplode(F.array(*[F.lit(c) for c in FEATS])).alias("position", "feature"))
    return output(serving.metadata_rows(stock_ids(f), names, metrics))


def _registry(spark, sf_dir, version: int, stamp: str, tickers: str):
    """Registry entries derived from the bars: one per ticker that matches ``tickers``."""
    b = fx.bars_hourly(spark, sf_dir).filter(F.col("Ticker").rlike(tickers)).groupBy("Ticker").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    when = F.lit(stamp).cast("timestamp")
    return b.select(
        F.concat(F.lit(f"m{version}-"), "Ticker").alias("id"), F.col("Ticker").alias("symbol"),
        F.concat(F.lit("key-"), "Ticker").alias("artifact_key"), F.lit("linear").alias("model_type"),
        F.lit(len(FEATS)).alias("features_count"), when.alias("model_timestamp"),
        F.create_map(F.lit("n"), F.col("n")).alias("metrics"), F.array(*[F.lit(c) for c in FEATS]).alias("feature_names"),
        *[F.concat(F.lit(f"v{version}/{k}/"), "Ticker").alias(f"{k}_file") for k in ("model", "scaler", "metadata")],
        F.lit(None if version == 2 else False).cast("boolean").alias("is_active"), when.alias("created_at"), when.alias("updated_at"))


REGISTRY = [("registry", f"""
SELECT DISTINCT CASE WHEN Ticker LIKE '%.NS' THEN 'm2-' ELSE 'm1-' END || Ticker AS id, Ticker AS symbol, 'key-' || Ticker AS artifact_key,
       'linear' AS model_type, {len(FEATS)} AS features_count, Ticker LIKE '%.NS' AS is_active,
       CASE WHEN Ticker LIKE '%.NS' THEN 'v2' ELSE 'v1' END || '/model/' || Ticker AS model_file,
       TIMESTAMP '2024-02-01 00:00:00' AS created_at,
       CASE WHEN Ticker LIKE '%.NS' THEN TIMESTAMP '2024-03-01 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS updated_at
FROM bars""")]


def registry_table(spark, sf_dir):
    return serving.registry_upsert(_registry(spark, sf_dir, 1, "2024-02-01", "."), _registry(spark, sf_dir, 2, "2024-03-01", r"\.NS$"))


@query("A15_registry_upsert", S.with_views(
    "SELECT id, symbol, artifact_key, model_type, features_count, is_active, model_file, created_at, updated_at FROM registry",
    [("bars", S.BARS_HOURLY), *REGISTRY]))
def q_registry(spark, sf_dir):
    """Entries of all tickers, then newer ones of the India tickers: newest wins, first created_at stays."""
    return output(registry_table(spark, sf_dir).select(
        "id", "symbol", "artifact_key", "model_type", "features_count", "is_active", "model_file", "created_at", "updated_at"))


JOBS = [("jobs", """
SELECT 'job-' || Ticker AS id, Ticker AS symbol,
       CASE WHEN Ticker LIKE 'E%' THEN NULL WHEN Ticker LIKE 'P%' THEN 'gone' WHEN Ticker LIKE '%.NS' THEN 'm2-' || Ticker ELSE 'm1-' || Ticker END AS model_registry_entry_id,
       max("Timestamp") AS requested_as_of_date, 'completed' AS status,
       CAST(CAST(CAST(arg_max("Close", "Timestamp") AS DECIMAL(14, 4)) AS DOUBLE) AS DOUBLE) AS latest_close, 'UP' AS predicted_direction
FROM bars GROUP BY Ticker""")]


def jobs_table(spark, sf_dir):
    b = fx.bars_hourly(spark, sf_dir).groupBy("Ticker").agg(
        F.max("Timestamp").alias("requested_as_of_date"), F.max_by("Close", "Timestamp").alias("latest_close"))
    t = F.col("Ticker")
    entry = (F.when(t.startswith("E"), F.lit(None)).when(t.startswith("P"), F.lit("gone"))
             .when(t.endswith(".NS"), F.concat(F.lit("m2-"), t)).otherwise(F.concat(F.lit("m1-"), t)))
    return serving.append_prediction_jobs(b.select(
        F.concat(F.lit("job-"), t).alias("id"), F.lower("Ticker").alias("symbol"), entry.alias("model_registry_entry_id"),
        "requested_as_of_date", "latest_close", F.lit("UP").alias("predicted_direction")))


@query("A14_prediction_log", S.with_views(
    f"SELECT id, symbol, model_registry_entry_id, requested_as_of_date, status, {S.r('latest_close', 4)} AS latest_close, predicted_direction FROM jobs",
    [("bars", S.BARS_HOURLY), *JOBS]))
def q_jobs(spark, sf_dir):
    """Prediction log rows: upper-case symbol, decimal columns, default status."""
    j = jobs_table(spark, sf_dir)
    return output(j.select("id", "symbol", "model_registry_entry_id", "requested_as_of_date", "status",
                           F.col("latest_close").cast("double").alias("latest_close"), "predicted_direction"), 4)


@query("C04_jobs_with_model", S.with_views(
    "SELECT j.id, j.symbol, j.model_registry_entry_id, r.artifact_key, r.model_type, r.is_active FROM jobs j LEFT JOIN registry r ON j.model_registry_entry_id = r.id",
    [("bars", S.BARS_HOURLY), *JOBS, *REGISTRY]))
def q_jobs_model(spark, sf_dir):
    j = serving.jobs_with_model(jobs_table(spark, sf_dir), registry_table(spark, sf_dir))
    return output(j.select("id", "symbol", "model_registry_entry_id", "artifact_key", "model_type", "is_active"))


@query("C05_orphans_and_duplicates", S.with_views(
    """SELECT 'orphan' AS problem, id AS name, 1 AS n FROM jobs WHERE model_registry_entry_id IS NOT NULL AND model_registry_entry_id NOT IN (SELECT id FROM registry)
UNION ALL SELECT 'duplicate', artifact_key, count(*) FROM (SELECT artifact_key FROM registry UNION ALL SELECT artifact_key FROM registry WHERE symbol LIKE '%.NS') x GROUP BY 2 HAVING count(*) > 1""",
    [("bars", S.BARS_HOURLY), *JOBS, *REGISTRY]))
def q_integrity(spark, sf_dir):
    """Jobs that name a missing model, and artifact keys that occur twice."""
    reg = registry_table(spark, sf_dir)
    lost = serving.orphans(jobs_table(spark, sf_dir), reg).select(F.lit("orphan").alias("problem"), F.col("id").alias("name"), F.lit(1).cast("long").alias("n"))
    twice = serving.duplicate_keys(reg.unionByName(reg.filter(F.col("symbol").endswith(".NS"))))
    return output(lost.unionByName(twice.select(F.lit("duplicate").alias("problem"), F.col("artifact_key").alias("name"), "n")))


@query("A16_published_stages", S.with_views(
    """SELECT 'raw' AS stage, count(*) AS n_rows, count(DISTINCT Ticker) AS n_tickers FROM bars
UNION ALL SELECT 'clean', count(*), count(DISTINCT Ticker) FROM cleaned
UNION ALL SELECT 'features', count(*), count(DISTINCT Ticker) FROM feats""",
    [("bars", S.BARS_HOURLY), ("cleaned", S.clean("bars")), ("feats", f"SELECT * FROM ({package_features_sql('hourly', rounded=False)}) z")]))
def q_stages(spark, sf_dir):
    """Raw, clean and feature tables as written by the pipeline, counted from their files."""
    out = io.scratch_path(spark, "stages")
    names = list(pipeline.run_pipeline(fx.bars_hourly(spark, sf_dir), out_dir=out))
    counted = [io.read_table(spark, f"{out}/{n}").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Ticker").alias("n_tickers"))
               .select(F.lit(n).alias("stage"), "n_rows", "n_tickers") for n in names]
    return output(counted[0].unionByName(counted[1]).unionByName(counted[2]))


@query("B02_utc_normalise", S.with_views(
    """SELECT Ticker, "Timestamp" AS from_text, "Timestamp" - INTERVAL 330 MINUTE AS from_local, "Timestamp" AS from_naive FROM bars""",
    [("bars", S.BARS_HOURLY)]))
def q_utc(spark, sf_dir):
    """Text stamps, naive stamps and Kolkata wall-clock stamps read as instants."""
    b = fx.bars_hourly(spark, sf_dir).select("Ticker", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("from_text"),
                                             F.col("Timestamp").cast("timestamp_ntz").alias("from_local"),
                                             F.col("Timestamp").cast("timestamp_ntz").alias("from_naive"))
    b = market.to_utc(market.to_utc(b, "from_text"), "from_local", tz="Asia/Kolkata")
    return output(market.to_utc(b, "from_naive"))


@query("B15_B20_B21_column_sets", S.with_views(
    f"""SELECT 'existing' AS kind, column_name AS name, n FROM (SELECT count("Close") AS "Close", count("Volume") AS "Volume" FROM f) UNPIVOT (n FOR column_name IN ("Close", "Volume"))
UNION ALL SELECT k.kind, u.name, u.n FROM (SELECT {', '.join(f'count({S.q(c)}) AS {S.q(c)}' for c in FEATS)} FROM f) UNPIVOT (n FOR name IN ({', '.join(S.q(c) for c in FEATS)})) u,
  (VALUES ('feature'), ('numeric')) k(kind)
UNION ALL SELECT 'numeric', name, n FROM (SELECT count(target_t2) AS target_t2, count(target_t3) AS target_t3 FROM f) UNPIVOT (n FOR name IN (target_t2, target_t3))""",
    FEATURE_CTES))
def q_columns(spark, sf_dir):
    """Requested columns that exist, feature columns and numeric columns of the feature frame, with their filled rows."""
    f = features(spark, sf_dir)
    sets = {"existing": cleaning.select_existing(f, ["Close", "Nope", "Volume"]).columns,
            "feature": cleaning.feature_cols(f), "numeric": cleaning.numeric_features(f, target="target_t1")}
    f = validate_features(f)
    return output(f.agg(*[F.count(c).alias(f"{k}:{c}") for k, cols in sets.items() for c in cols]).select(F.explode(F.array(
        *[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("name"), F.col(f"`{k}:{c}`").alias("n")) for k, cols in sets.items() for c in cols])).alias("x")).select("x.*"))


FIRST_COPIES = ("first_copies", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Ticker, "Timestamp" ORDER BY _seq) AS k FROM bars) x WHERE k = 1""")


@query("B16_fill_report", S.with_views(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", sum(before) AS nulls_before, sum(after) AS nulls_after, sum(before) - sum(after) AS filled FROM (
  SELECT CAST({S.q(c)} IS NULL AS BIGINT) AS before, CAST(count({S.q(c)}) OVER (PARTITION BY Ticker) = 0 AS BIGINT) AS after FROM first_copies) y""" for c in C.PRICE_COLUMNS),
    [("bars", S.BARS_DIRTY), FIRST_COPIES]))
def q_fill_report(spark, sf_dir):
    """NULLs per price column before and after the fill."""
    _, report = cleaning.fill_prices_report(market.dedup_first(fx.bars_dirty(spark, sf_dir)))
    return output(report.select("column", "nulls_before", "nulls_after", "filled"))


@query("B19_model_matrix", S.with_views(
    'SELECT "Timestamp", Ticker, ' + ", ".join(
        f"""{S.r(f'coalesce(last_value({S.q(c)} IGNORE NULLS) OVER (PARTITION BY Ticker ORDER BY "Timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)')} AS {S.q(c)}"""
        for c in ("Close", "Volume")) + " FROM first_copies", [("bars", S.BARS_DIRTY), FIRST_COPIES]))
def q_matrix(spark, sf_dir):
    """Forward fill inside each series, then 0."""
    d = cleaning.fill_model_matrix(market.dedup_first(fx.bars_dirty(spark, sf_dir)), ["Close", "Volume"])
    return output(d.select("Timestamp", "Ticker", "Close", "Volume"))


@query("C03_align", S.with_views(
    f"""SELECT a.Ticker, a."Timestamp", {S.r('a.yhat')} AS actual, {S.r('b.yhat')} AS predicted FROM preds a JOIN preds b ON a.Ticker = b.Ticker AND a."Timestamp" = b."Timestamp"
WHERE a.Model = 'naive' AND b.Model = 'lag5'""", PRED_CTES))
def q_align(spark, sf_dir):
    """Two prediction series aligned by key: the shorter one bounds the result."""
    p = preds(spark, sf_dir)
    side = lambda m, name: p.filter(F.col("Model") == m).select("Ticker", "Timestamp", F.col("yhat").alias(name))
    return output(serving.align(side("naive", "actual"), side("lag5", "predicted")).select("Ticker", "Timestamp", "actual", "predicted"))


@query("F04_date_parts", S.with_views(
    """SELECT Ticker, "Timestamp", CAST(year("Timestamp") AS INTEGER) AS "Year", CAST(month("Timestamp") AS INTEGER) AS "Month",
       monthname("Timestamp") AS "Month_Name", dayname("Timestamp") AS "DayOfWeek_Name" FROM bars""", [("bars", S.BARS_DAILY)]))
def q_dates(spark, sf_dir):
    d = notebook.date_parts(fx.bars_daily(spark, sf_dir))
    return output(d.select("Ticker", "Timestamp", "Year", "Month", "Month_Name", "DayOfWeek_Name"))


@query("H01_H02_I03_sorted_head", S.with_views(
    f'SELECT {BAR_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY "Timestamp") AS k FROM bars) x WHERE k <= 5',
    [("bars", S.BARS_DAILY)]))
def q_head(spark, sf_dir):
    """First five bars per ticker of a validated table, in (Ticker, Timestamp) order."""
    return output(market.sort_bars(series.head_n(validate_bars(fx.bars_daily(spark, sf_dir)), 5)).select(*C.BAR_COLUMNS))


@query("H03_rank_models", S.with_views(
    f"""SELECT Model, {S.r('rmse')} AS rmse, {S.r('mae')} AS mae, row_number() OVER (ORDER BY rmse, Model) AS rank FROM (
  SELECT Model, sqrt(avg(power(y - yhat, 2))) AS rmse, avg(abs(y - yhat)) AS mae FROM preds GROUP BY Model) x""", PRED_CTES))
def q_rank(spark, sf_dir):
    """Comparison table in order, with its places (one row per model)."""
    m = ev.rank_models(ev.rmse_mae(preds(spark, sf_dir)), metric="rmse")
    return output(m.select("Model", "rmse", "mae", "rank"))


@query("J10_assemble", S.with_views(
    f"""SELECT Ticker, "Timestamp", {len(FEATS)} AS width, {S.r(' + '.join(f'{i + 1} * CAST({S.q(c)} AS DOUBLE)' for i, c in enumerate(FEATS)), 4)} AS weighted FROM f""",
    FEATURE_CTES))
def q_assemble(spark, sf_dir):
    """Feature matrix column; each cell weighted by its position, so a swapped order shows."""
    d = dataset.assemble(features(spark, sf_dir), FEATS)
    weighted = F.aggregate(F.transform("features", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return output(d.select("Ticker", "Timestamp", F.size("features").alias("width"), weighted.alias("weighted")), 4)
