"""Streaming queries (M01-M04): drained with availableNow triggers, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import output
from barspark.operators import cleaning, market
from barspark.plans import sql as S
from barspark.plans.q_features import package_features_sql
from barspark.plans.registry import query
from barspark.sources import fixtures as fx
from barspark.sources.bars_io import scratch_path
from barspark.streaming import streams

BAR_OUT = '"Timestamp", Ticker, ' + S.rcols(C.PRICE_COLUMNS)


# Arrival order of the time slices of a replayed source: neighbours swapped, as late files would be.
SLICES = (1, 0, 3, 2, 5, 4)


def replayed(spark, df, name: str):
    """``df`` as a stream of one file per micro-batch: time slices that arrive out of order."""
    src = scratch_path(spark, name)
    span = df.agg(F.min("Timestamp").alias("lo"), F.max("Timestamp").alias("hi")).first()
    step = (span["hi"] - span["lo"]) / len(SLICES)
    for k in SLICES:
        part = df.filter((F.col("Timestamp") >= F.lit(span["lo"] + k * step))
                         & ((F.col("Timestamp") < F.lit(span["lo"] + (k + 1) * step)) | F.lit(k == len(SLICES) - 1)))
        part.coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


@query("M02_stream_bars_from_ticks", S.with_views(f"SELECT {BAR_OUT} FROM bars", [("bars", S.BARS_HOURLY)]))
def q_stream_bars(spark, sf_dir):
    """Tick stream (the events files) -> hourly OHLCV bars in tumbling windows with a watermark."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    # A file stream source lists a directory or a glob; the glob picks the events file(s).
    ticks = (spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events*.parquet")
             .withColumn("ts", F.col("ts").cast("timestamp")))
    ticker = F.concat(F.upper("event_type"),
                      F.when(F.col("event_type").isin("click", "view"), F.lit(".NS")).otherwise(F.lit("")))
    table = streams.run_to_table(spark, streams.bars_from_ticks(ticks, ticker), "m02", mode="update")
    # update mode may emit a window more than once: the last emission is the final bar
    return output(streams.read_stream_table(spark, table, ["Timestamp", "Ticker"]).select(*C.BAR_COLUMNS))


@query("M01_clean_stream", S.with_views(
    f"SELECT {BAR_OUT} FROM ({S.trading_hours('bars')}) t", [("bars", S.BARS_DIRTY)]))
def q_clean_stream(spark, sf_dir):
    """Dirty bar stream in six micro-batches, out of order -> first copy per bar -> session filter."""
    dirty = fx.bars_dirty(spark, sf_dir)
    stream = streams.clean_stream(replayed(spark, dirty, "m01-src"), market.bar_cadence(dirty), watermark="12 days")
    table = streams.run_to_table(spark, stream, "m01", mode="update")
    return output(streams.read_stream_table(spark, table, ["Timestamp", "Ticker"]).select(*C.BAR_COLUMNS))


IND_SQL = S.with_views(
    'SELECT "Timestamp", Ticker, ' + S.rcols(["Close"] + streams.INDICATOR_COLS) + " FROM f",
    [("f", package_features_sql("hourly", drop_nulls=False, rounded=False))])


def _indicators(spark, sf_dir, name):
    clean = cleaning.clean_market_data(fx.bars_hourly(spark, sf_dir))
    return streams.indicator_stream(replayed(spark, clean, name), watermark="12 days")


@query("M03_indicator_stream", IND_SQL)
def q_indicator_stream(spark, sf_dir):
    """Clean bars in six micro-batches, out of order -> stateful return/EMA/MACD/RSI/rolling stats (equals batch E)."""
    table = streams.run_to_table(spark, _indicators(spark, sf_dir, "m03-src"), "m03", mode="update")
    out = streams.read_stream_table(spark, table, ["Timestamp", "Ticker"])
    return output(out.select("Timestamp", "Ticker", "Close", *streams.INDICATOR_COLS))


@query("M04_latest_features_stream", S.with_views(
    'SELECT "Timestamp", Ticker, ' + S.rcols(["Close"] + streams.INDICATOR_COLS) +
    ' FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY "Timestamp" DESC) AS k FROM f) x WHERE k = 1',
    [("f", package_features_sql("hourly", drop_nulls=False, rounded=False))]))
def q_latest_stream(spark, sf_dir):
    """foreachBatch upsert of the newest indicator row per ticker into a versioned table, over six micro-batches."""
    rows = _indicators(spark, sf_dir, "m04-src").where("not is_late")
    path = streams.run_to_table(spark, rows, "m04", mode="update", upsert_keys=["Ticker"])
    return output(streams.read_stream_table(spark, path).select("Timestamp", "Ticker", "Close", *streams.INDICATOR_COLS))
