"""Batch serving and persisted-table operators.

The reference answers one HTTP request at a time; here every request of a batch is answered by
one job: requests are joined to bars as of their cutoff, the latest window is built per request,
scored by a per-partition model and turned into intervals/confidence.
"""

from __future__ import annotations

from typing import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark import config as C
from barspark.plans import series
from barspark.schema import JOBS_SCHEMA, REGISTRY_SCHEMA


ASKS_PER_TASK = 100_000  # requests of one series and time block that are placed together


def asof_positions(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """``requests`` (Ticker, as_of, ...) with ``_end``, the number of the series' bars at or before
    as_of (NULL = all of them); 0 for a ticker without bars.

    A count table with a row per series and time block gives the bars before a request's block. Inside
    the block, requests and bar stamps are sorted together and the bars are counted; only blocks that
    hold requests are read, and a block with very many requests is split by salt.
    """
    secs = series.block_seconds(bars)
    asks = requests.filter(F.col("Ticker").isNotNull())
    latest = F.lit(2 ** 62)  # after every block
    asks = asks.select(F.struct(*requests.columns).alias("_ask_row"), "Ticker", F.col("as_of").cast("timestamp").alias("_at"),
                       F.coalesce(series.time_block(F.col("as_of"), secs), latest).alias("_blk"))
    stamps = bars.select("Ticker", F.col("Timestamp").cast("timestamp").alias("_at"),
                         series.time_block(F.col("Timestamp"), secs).alias("_blk"))
    tally = lambda d, n_bars, n_asks: d.groupBy("Ticker", "_blk").agg(n_bars.alias("_bars"), n_asks.alias("_asks"))
    zero, one = F.lit(0).cast("long"), F.count(F.lit(1))
    grid = tally(tally(stamps, one, F.max(zero)).unionByName(tally(asks, F.max(zero), one)), F.sum("_bars"), F.sum("_asks"))
    before = Window.partitionBy("Ticker").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("Ticker", "_blk", "_bars", "_asks", F.coalesce(F.sum("_bars").over(before), zero).alias("_before"),
                       F.ceil(F.col("_asks") / ASKS_PER_TASK).cast("int").alias("_salts"))
    grid = grid.filter("_asks > 0").drop("_asks")
    placed = asks.join(grid.drop("_bars"), ["Ticker", "_blk"])
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64("_ask_row"), F.col("_salts")).cast("int"))
    seen = (stamps.join(grid.filter("_bars > 0").select("Ticker", "_blk", "_salts"), ["Ticker", "_blk"])
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts"))
    both = seen.withColumn("_is_ask", F.lit(0)).unionByName(placed.drop("_salts").withColumn("_is_ask", F.lit(1)), allowMissingColumns=True)
    so_far = (Window.partitionBy("Ticker", "_blk", "_salt").orderBy("_at", "_is_ask")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("_in", F.sum(1 - F.col("_is_ask")).over(so_far)).filter("_is_ask = 1")
    return both.select("_ask_row.*", (F.col("_before") + F.col("_in")).alias("_end"))


def asof_pairs(placed: DataFrame, indexed: DataFrame, n: int) -> DataFrame:
    """Requests with ``_end`` against the bars (``_rn``) of the at most two stretches of ``n`` positions
    that hold positions ``_end - n`` to ``_end - 1``: at most 2n rows a request, whatever the history."""
    first, last = F.greatest(F.col("_end") - n, F.lit(0)), F.col("_end") - 1
    asks = placed.filter("_end > 0").withColumn("_part", F.explode(F.sequence(F.floor(first / n), F.floor(last / n))))
    return asks.join(indexed.withColumn("_part", F.floor(F.col(series.RN) / n)), ["Ticker", "_part"]).drop("_part")


def asof_bars(requests: DataFrame, bars: DataFrame, n: int | None = None) -> DataFrame:
    """For each request (Ticker, as_of) the bars at or before as_of (NULL = latest), newest n.

    Equal requests are folded first and each gets the whole answer: ``request`` numbers them (1, 2,
    ...). With ``n`` a request is turned into its position in the series and fetches bars by position;
    no request meets the history. Without, the whole history is the answer and is joined by Ticker.
    """
    folded = requests.groupBy(*requests.columns).agg(F.count(F.lit(1)).alias("_copies"))
    if n is None:
        j = folded.join(bars, "Ticker").filter(F.col("as_of").isNull() | (F.col("Timestamp") <= F.col("as_of")))
    else:
        pairs = asof_pairs(asof_positions(folded, bars), series.index_rows(bars), n)
        j = pairs.filter((F.col(series.RN) < F.col("_end")) & (F.col(series.RN) >= F.col("_end") - n)).drop("_end", series.RN)
    return j.withColumn("request", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copies")


def align(actual: DataFrame, pred: DataFrame, on: Sequence[str] = ("Ticker", "Timestamp")) -> DataFrame:
    """prediction/actual alignment by key (inner join: the shorter side wins, as truncation)."""
    return actual.join(pred, list(on), "inner")


def align_positional(actual: DataFrame, pred: DataFrame, keys: Sequence[str] = ("Ticker",),
                     order: str = "Timestamp") -> DataFrame:
    """C03 (positional variant): i-th actual with i-th prediction per key; inner = min length."""
    wa = Window.partitionBy(*keys).orderBy(order)
    a = actual.withColumn("_pos", F.row_number().over(wa))
    p = pred.withColumn("_pos", F.row_number().over(wa)).drop(order)
    return a.join(p, [*keys, "_pos"]).drop("_pos")


def jobs_with_model(jobs: DataFrame, registry: DataFrame) -> DataFrame:
    """Each prediction job with its model entry (nullable FK, missing parent allowed)."""
    reg = registry.select(F.col("id").alias("model_registry_entry_id"), "artifact_key", "model_type", "features_count",
                          "model_timestamp", "is_active")
    return jobs.join(reg, "model_registry_entry_id", "left")


def orphans(jobs: DataFrame, registry: DataFrame) -> DataFrame:
    """Jobs whose non-NULL model_registry_entry_id has no registry row."""
    return jobs.filter(F.col("model_registry_entry_id").isNotNull()).join(
        registry.select(F.col("id").alias("model_registry_entry_id")), "model_registry_entry_id", "left_anti")


def duplicate_keys(registry: DataFrame, key: str = "artifact_key") -> DataFrame:
    """Unique-key violations."""
    return registry.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Rows in a persisted table's columns and types: missing columns are NULL, then defaults apply."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(c, defaults[f.name].cast(f.dataType)) if f.name in defaults else c).alias(f.name))
    return df.select(*cols)


def append_prediction_jobs(df: DataFrame) -> DataFrame:
    """Rows of the prediction log (decimal money columns, upper-case symbol, status default)."""
    d = df.withColumn("symbol", F.upper("symbol"))
    return conform(d, JOBS_SCHEMA, {"status": F.lit("completed"), "created_at": F.col("requested_as_of_date")})


def registry_upsert(existing: DataFrame, new: DataFrame, key: str = "artifact_key") -> DataFrame:
    """Union, newest ``updated_at`` per artifact key wins and keeps the first ``created_at``;
    ``is_active`` defaults to true."""
    u = existing.unionByName(new)
    w = Window.partitionBy(key).orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc())
    top = u.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") == 1).drop("_k", "created_at")
    first = u.groupBy(key).agg(F.min("created_at").alias("created_at"))
    return conform(top.join(first, key), REGISTRY_SCHEMA, {"is_active": F.lit(True)})


def metadata_rows(stock_ids: DataFrame, features: DataFrame, metrics: DataFrame, seq_len: int = C.SEQUENCE_LENGTH,
                  model_version: str = "v1") -> DataFrame:
    """Model metadata as rows (kind, name, value): settings, feature positions, stock ids and
    metrics. One row per entry, so a map of all tickers never has to fit one row."""
    def rows(df: DataFrame, kind: str, name: str, value: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))

    settings = features.agg(F.count(F.lit(1)).alias("input_dim")).select(F.explode(F.create_map(
        F.lit("input_dim"), F.col("input_dim").cast("double"), F.lit("sequence_length"), F.lit(float(seq_len)),
        F.lit("output_dim"), F.lit(float(C.HORIZON)))).alias("name", "value"))
    parts = [rows(settings, "setting", "name", "value"), rows(features, "feature", "feature", "position"),
             rows(stock_ids, "stock", "Ticker", "stock_id"), rows(metrics, "metric", "metric", "value")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("model_version", F.lit(model_version))


def score_batch(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.Series]],
                out_col: str = "predictions") -> DataFrame:
    """Score rows with a model built once per partition (``mapInPandas`` iterator)."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches):
        model = make_model()
        for pdf in batches:
            pdf[out_col] = model(pdf)
            yield pdf

    return df.mapInPandas(run, schema)


def predict_batch(requests: DataFrame, features: DataFrame, predict: Callable[[DataFrame], DataFrame], sigma: DataFrame,
                  feature_cols: Sequence[str], seq_len: int = C.SEQUENCE_LENGTH, horizon: int = C.HORIZON,
                  model_version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """Answer every request of a batch in one job; each is answered or rejected with a reason.

    requests (Ticker, as_of) -> their position among the complete feature rows -> the newest
    ``horizon`` rows are dropped (their targets are unknown as of the request, as in the reference,
    T7) -> at least ``seq_len`` rows before them required (B24) -> ``predict`` adds ``predictions``
    (one per horizon) to the newest remaining row, the only one a request reads -> intervals and
    confidence from ``sigma`` (one-row rmse/mae table, L18/L19). Equal requests are worked out once
    and answered as often as asked. Returns (responses, rejected requests with a reason).
    """
    from barspark.operators.cleaning import reject_unknown
    from barspark.operators.evaluate import interval_and_confidence

    folded = requests.groupBy("Ticker", "as_of").agg(F.count(F.lit(1)).alias("_copies"))
    accepted, unknown = reject_unknown(folded, features)
    complete = features.na.drop(subset=list(feature_cols))
    asked = asof_positions(accepted, complete).withColumn("_ok", F.col("_end") >= seq_len + horizon)
    newest = (asked.filter("_ok").withColumn(series.RN, F.col("_end") - (horizon + 1))
              .join(series.index_rows(complete), ["Ticker", series.RN]).drop(series.RN, "_end", "_ok"))
    again = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("request")
    rejected = (asked.filter(~F.col("_ok")).withColumn("reason", F.lit(f"fewer than {seq_len} feature rows"))
                .select("Ticker", "as_of", "_copies", "reason")
                .unionByName(unknown.select("Ticker", "as_of", "_copies", "reason")).select("Ticker", "as_of", "reason", again))
    scored = predict(newest).crossJoin(F.broadcast(sigma.select("rmse", "mae")))
    ic = interval_and_confidence(F.col("predictions"), F.col("rmse"), F.col("mae"))
    resp = scored.select(F.col("Ticker").alias("ticker"), "as_of", again, F.col("Timestamp").alias("feature_ts"), "predictions",
                         ic["confidence"].alias("confidence"), ic["intervals"].alias("intervals"),
                         F.lit(model_version).alias("model_version"))
    return resp, rejected
