"""Markets, local time, cadence and the trading-hours filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark import config
from barspark.plans import series
from barspark.schema import SEQ


def is_india(ticker: Column) -> Column:
    up = F.upper(ticker)
    cond = F.lit(False)
    for suffix in config.INDIA_SUFFIXES:
        cond = cond | up.endswith(suffix)
    return cond


def _pick(ticker: Column, key: str) -> Column:
    return F.when(is_india(ticker), F.lit(config.INDIA_MARKET[key])).otherwise(F.lit(config.US_MARKET[key]))


def market_dim(spark) -> DataFrame:
    """The two market profiles as a dimension table."""
    rows = [(m["market"], ",".join(config.INDIA_SUFFIXES) if m is config.INDIA_MARKET else "*",
             m["timezone"], m["open_min"], m["close_min"]) for m in (config.INDIA_MARKET, config.US_MARKET)]
    return spark.createDataFrame(rows, "market string, suffix string, timezone string, open_min int, close_min int")


def with_market(df: DataFrame, ticker: str = "Ticker") -> DataFrame:
    """Attach the market profile by ticker suffix (B03); a CASE, no join needed for 2 profiles."""
    t = F.col(ticker)
    return df.withColumns({"market": _pick(t, "market"), "timezone": _pick(t, "timezone"),
                           "open_min": _pick(t, "open_min"), "close_min": _pick(t, "close_min")})


def local_time(ts: Column, ticker: Column) -> Column:
    """Wall clock in the ticker's market time zone."""
    return F.from_utc_timestamp(ts, _pick(ticker, "timezone"))


def to_utc(df: DataFrame, col: str = "Timestamp", tz: str | None = None) -> DataFrame:
    """strings/naive stamps -> instants. Naive values are read as UTC unless ``tz`` is given."""
    c = F.col(col)
    if dict(df.dtypes)[col] == "string":
        c = F.to_timestamp(c)
    elif dict(df.dtypes)[col] == "timestamp_ntz":
        c = c.cast("timestamp")
    if tz:
        c = F.to_utc_timestamp(c, tz)
    return df.withColumn(col, c)


def as_of(df: DataFrame, cutoff, col: str = "Timestamp") -> DataFrame:
    """Keep bars at or before ``cutoff`` (naive = UTC). Pushes down to the parquet scan."""
    return df.filter(F.col(col) <= F.lit(cutoff).cast("timestamp"))


def is_weekday(local: Column) -> Column:
    return F.weekday(local) < 5


def in_session(local: Column, ticker: Column) -> Column:
    minutes = F.hour(local) * 60 + F.minute(local)
    return minutes.between(_pick(ticker, "open_min"), _pick(ticker, "close_min"))


def bar_cadence(df: DataFrame) -> DataFrame:
    """Per ticker, bar count, median gap (seconds) between sorted stamps and ``is_daily``.

    Rows are hash-partitioned once by (Ticker, time block). Copies per stamp, the previous stamp
    inside a block (lag) and the per-block maximum all reuse that partitioning. The first stamp
    of a block takes the previous block's maximum from a small one-row-per-block table.
    Duplicated stamps add zero gaps as one weighted row. The exact median is
    ``percentile(gap, 0.5, weight)`` with partial aggregation, so there is no per-ticker sort and
    no whole-ticker task.
    """
    secs = series.block_seconds(df)
    d = (df.filter(F.col("Ticker").isNotNull() & F.col("Timestamp").isNotNull())
         .withColumn("_blk", F.floor(F.unix_micros("Timestamp") / F.lit(secs * 1_000_000)))
         .repartition("Ticker", "_blk"))
    distinct = d.groupBy("Ticker", "_blk", "Timestamp").agg(F.count(F.lit(1)).alias("_copies"))
    in_block = Window.partitionBy("Ticker", "_blk").orderBy("Timestamp")
    g = distinct.withColumn("_prev", F.lag("Timestamp").over(in_block))
    blocks = distinct.groupBy("Ticker", "_blk").agg(F.max("Timestamp").alias("_bmax"))
    prev_block = blocks.select("Ticker", "_blk", F.lag("_bmax").over(Window.partitionBy("Ticker").orderBy("_blk")).alias("_pb"))
    g = g.join(prev_block, ["Ticker", "_blk"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_pb"))
    gap = F.unix_micros("Timestamp") / 1e6 - F.unix_micros(prev) / 1e6
    weighted = g.select("Ticker", F.explode(F.array(
        F.struct(gap.alias("_gap"), F.lit(1).cast("long").alias("_w")),
        F.struct(F.lit(0.0).alias("_gap"), (F.col("_copies") - 1).alias("_w")))).alias("s")).select("Ticker", "s.*")
    weighted = weighted.filter(F.col("_gap").isNotNull() & (F.col("_w") > 0))
    med = weighted.groupBy("Ticker").agg(F.percentile("_gap", 0.5, F.col("_w")).alias("median_gap_seconds"))
    counts = distinct.groupBy("Ticker").agg(F.sum("_copies").alias("n_bars"))
    out = counts.join(med, "Ticker", "left")
    return out.withColumn("is_daily", F.coalesce(
        (F.col("n_bars") >= 2) & (F.col("median_gap_seconds") >= config.DAILY_MEDIAN_GAP_SECONDS), F.lit(False)))


def sort_bars(df: DataFrame) -> DataFrame:
    """Total order (Ticker, Timestamp) at a sink; a range exchange, not one partition."""
    return df.orderBy("Ticker", "Timestamp")


def dedup_first(df: DataFrame, keys=("Ticker", "Timestamp")) -> DataFrame:
    """First copy in input order (``_seq``) wins. ``row_number() == 1`` plans a
    WindowGroupLimit, so copies are cut map-side before the shuffle (a hot duplicate group
    never lands whole in one task)."""
    order = [F.col(SEQ)] if SEQ in df.columns else [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter(F.col("_first") == 1).drop("_first")


def filter_trading_hours(df: DataFrame, cadence: DataFrame | None = None) -> DataFrame:
    """Weekday in local time; intraday series must also lie inside the session.

    ``cadence`` (Ticker, is_daily) may be passed in (streams, or a cached table); otherwise it is
    computed from ``df``. Output is deduplicated on (Ticker, Timestamp), first copy wins.
    """
    df = df.filter(F.col("Ticker").isNotNull())
    cad = (cadence if cadence is not None else bar_cadence(df)).select("Ticker", "is_daily")
    local = local_time(F.col("Timestamp"), F.col("Ticker"))
    keep = is_weekday(local) & (F.col("is_daily") | in_session(local, F.col("Ticker")))
    return dedup_first(df.join(cad, "Ticker", "left").filter(keep).drop("is_daily"))


def session_bars(df: DataFrame) -> DataFrame:
    """B05/B06 as columns: local stamp, weekday flag and session flag per bar."""
    local = local_time(F.col("Timestamp"), F.col("Ticker"))
    return df.withColumns({"local_ts": local, "is_weekday": is_weekday(local),
                           "in_session": in_session(local, F.col("Ticker"))})
