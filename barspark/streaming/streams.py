"""Structured Streaming versions of the bar pipeline.

File sources with ``availableNow`` triggers, watermarks for late data and bounded state. Every
result is the same for any split of the input into micro-batches, as long as rows arrive within the
watermark: operators emit a row again when a later batch changes it, and a sink keeps each key's
newest version. Sinks write one folder per batch id, so a batch that is run again replaces its own
rows. Checkpoints and sinks live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from barspark import config as C
from barspark.operators.market import SEQ, in_session, is_weekday, local_time
from barspark.sources.bars_io import path_exists, scratch_path

BATCH = "_batch"


def bars_from_ticks(ticks: DataFrame, ticker: F.Column, price: str = "value", ts: str = "ts",
                    tiebreak: str = "event_id", interval: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Tumbling-window OHLCV bars from a tick stream (state evicted behind the watermark)."""
    order = F.struct(ts, tiebreak)
    return (ticks.withWatermark(ts, watermark)
            .groupBy(F.window(ts, interval).alias("w"), ticker.alias("Ticker"))
            .agg(F.min_by(price, order).alias("Open"), F.max(price).alias("High"), F.min(price).alias("Low"),
                 F.max_by(price, order).alias("Close"), F.count(F.lit(1)).cast("double").alias("Volume"))
            .select(F.col("w.start").alias("Timestamp"), "Ticker", "Open", "High", "Low", "Close", "Volume"))


def clean_stream(bars: DataFrame, cadence: DataFrame, watermark: str = "3 hours") -> DataFrame:
    """The first copy (smallest ``_seq``) of each (Ticker, Timestamp) bar inside the watermark,
    then the weekday/session filter. Run in update mode: a copy with a smaller ``_seq`` that comes in
    a later batch replaces the one sent before. Daily series are flagged by a static cadence table (a
    median needs all rows)."""
    cols = [c for c in bars.columns if c not in ("Ticker", "Timestamp")]
    d = (bars.withWatermark("Timestamp", watermark).groupBy("Ticker", "Timestamp")
         .agg(F.min_by(F.struct(*cols), SEQ).alias("_bar")).select("Ticker", "Timestamp", "_bar.*"))
    d = d.join(cadence.select("Ticker", "is_daily"), "Ticker", "left")
    local = local_time(F.col("Timestamp"), F.col("Ticker"))
    keep = is_weekday(local) & (F.coalesce(F.col("is_daily"), F.lit(False)) | in_session(local, F.col("Ticker")))
    return d.filter(keep).drop("is_daily")


INDICATOR_COLS = ["return_1", "ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist", "rsi",
                  "rolling_mean_5", "rolling_std_5", "rolling_mean_10", "rolling_std_10",
                  "rolling_mean_20", "rolling_std_20"]
# State: everything up to the last final bar (closes for the look-back windows, EMA values), and the
# bars inside the watermark, which may still get neighbours.
STATE_SCHEMA = T.StructType([
    T.StructField("closes", T.ArrayType(T.DoubleType())), T.StructField("emas", T.ArrayType(T.DoubleType())),
    T.StructField("final_us", T.LongType()), T.StructField("open_us", T.ArrayType(T.LongType())),
    T.StructField("open_closes", T.ArrayType(T.DoubleType()))])
OUT_SCHEMA = T.StructType([T.StructField("Timestamp", T.TimestampType()), T.StructField("Ticker", T.StringType()),
                           T.StructField("Close", T.DoubleType())]
                          + [T.StructField(c, T.DoubleType()) for c in INDICATOR_COLS]
                          + [T.StructField("is_late", T.BooleanType())])
HISTORY = max(max(C.ROLLING_WINDOWS), C.RSI_WINDOW + 1)


def _trailing(x: np.ndarray, n: int) -> np.ndarray:
    """The n values up to each position, as rows; NaN where there are fewer."""
    padded = np.concatenate([np.full(n - 1, np.nan), x])
    return np.lib.stride_tricks.sliding_window_view(padded, n)


def _ema(x: np.ndarray, span: int, before: float | None) -> np.ndarray:
    out, a = np.empty(len(x)), 2.0 / (span + 1.0)
    for i, v in enumerate(x):
        before = v if before is None else before + a * (v - before)
        out[i] = before
    return out


def indicator_rows(closes: np.ndarray, history: Sequence[float], emas: Sequence[float] | None) -> dict[str, np.ndarray]:
    """Package indicators of ``closes``, continuing from the closes and EMA values before them."""
    full = np.concatenate([np.asarray(history, dtype=float), closes])
    old = len(history)
    fast, slow = _ema(closes, C.EMA_FAST, emas and emas[0]), _ema(closes, C.EMA_SLOW, emas and emas[1])
    signal = _ema(fast - slow, C.MACD_SIGNAL, emas and emas[2])
    change = np.diff(full, prepend=np.nan)
    moves = _trailing(change, C.RSI_WINDOW)
    up, down = np.maximum(moves, 0).mean(axis=1), np.maximum(-moves, 0).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = np.where(down > 0, 100.0 * up / (up + down), 100.0)  # no losses, or warm-up: 100
        before = np.concatenate([[np.nan], full[:-1]])
        returns = np.where(before != 0, change / before, np.nan)
    out = {"return_1": returns[old:], "ema_fast": fast, "ema_slow": slow, "macd": fast - slow, "macd_signal": signal,
           "macd_hist": fast - slow - signal, "rsi": np.where(np.isnan(up), 100.0, strength)[old:]}
    for n in C.ROLLING_WINDOWS:
        w = _trailing(full, n)[old:]
        out[f"rolling_mean_{n}"], out[f"rolling_std_{n}"] = w.mean(axis=1), w.std(axis=1, ddof=1)
    return out


def _indicators(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Bars inside the watermark are worked out again from the last final bar and sent again; a bar
    at or before the last final one is late: it is sent with ``is_late`` and no values."""
    closes, emas, final, open_us, open_closes = state.get if state.exists else ([], None, None, [], [])
    waiting = dict(zip(open_us, open_closes))
    late: list[tuple[int, float]] = []
    for pdf in batches:
        for us, close in zip(pdf["us"].tolist(), pdf["Close"].tolist()):
            if final is not None and us <= final:
                late.append((us, close))
            else:
                waiting.setdefault(us, close)
    stamps = sorted(waiting)
    x = np.array([waiting[s] for s in stamps], dtype=float)
    rows = indicator_rows(x, closes, emas)
    settled = int(np.searchsorted(np.array(stamps, dtype=np.int64), state.getCurrentWatermarkMs() * 1000))
    if settled:
        closes = [*closes, *x[:settled].tolist()][-HISTORY:]
        emas = [float(rows[c][settled - 1]) for c in ("ema_fast", "ema_slow", "macd_signal")]
        final = stamps[settled - 1]
    state.update((list(closes), emas, final, stamps[settled:], x[settled:].tolist()))
    out = pd.DataFrame({"Timestamp": pd.to_datetime(stamps, unit="us"), "Ticker": key[0], "Close": x, **rows, "is_late": False})
    missed = pd.DataFrame({"Timestamp": pd.to_datetime([u for u, _ in late], unit="us"), "Ticker": key[0],
                           "Close": np.array([c for _, c in late], dtype=float), "is_late": True})
    for part in (out, missed):
        if len(part):
            yield part.reindex(columns=[f.name for f in OUT_SCHEMA.fields])


def indicator_stream(bars: DataFrame, watermark: str = "10 days") -> DataFrame:
    """Per-ticker stateful indicators, the same for any order of arrival inside the watermark.

    Output is in update fashion: the newest version of a (Ticker, Timestamp) row counts. Late bars
    come out as rows with ``is_late``, so they can be counted. State per ticker: 20 closes, 3 EMA
    values and the bars of the last ``watermark``."""
    d = bars.withWatermark("Timestamp", watermark).select("Timestamp", "Ticker", "Close", F.unix_micros("Timestamp").alias("us"))
    return d.groupBy("Ticker").applyInPandasWithState(
        _indicators, OUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def newest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def _current(spark: SparkSession, out: str) -> tuple[int, str] | None:
    """(batch id, path) of the table version that readers see; None before the first batch."""
    if not path_exists(spark, f"{out}/current"):
        return None
    row = spark.read.schema("batch long, path string").json(f"{out}/current").orderBy(F.col("batch").desc()).first()
    return row and (row["batch"], row["path"])


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append",
                 upsert_keys: list[str] | None = None, latest: Sequence[str] = ("Timestamp",)) -> str:
    """Drain ``stream`` with an availableNow trigger into parquet; returns the table path.

    Each batch is one folder ``_batch=<id>``. ``upsert_keys`` (M04): each batch makes a new version of
    the table, the old version merged with the batch, newest row per key by ``latest``; a pointer names
    the version readers see. A batch that is run again starts from the version before it.
    """
    out = scratch_path(spark, name)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        now = _current(spark, out)
        if now and now[0] >= batch_id:
            return  # this batch is already part of the table
        rows = batch.withColumn(BATCH, F.lit(batch_id).cast("long"))
        if now:
            rows = spark.read.schema(rows.schema).parquet(now[1]).unionByName(rows)
        version = f"{out}/version-{batch_id}"
        newest(rows, upsert_keys, *latest, BATCH).write.mode("overwrite").parquet(version)
        spark.createDataFrame([(batch_id, version)], "batch long, path string").write.mode("append").json(f"{out}/current")

    q = (stream.writeStream.outputMode(mode).foreachBatch(upsert if upsert_keys else append)
         .option("checkpointLocation", scratch_path(spark, name + "-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return _current(spark, out)[1] if upsert_keys else out


def read_stream_table(spark: SparkSession, path: str, keys: Sequence[str] | None = None) -> DataFrame:
    """A sink table; with ``keys``, the newest version of each row."""
    d = spark.read.parquet(path)
    return newest(d, keys, BATCH) if keys else d
