"""Bar tables derived from the driver's read-only tables (see FIXTURES.md §2).

Each view is an ordinary Spark job over the given parquet files, so its work grows with them.
The driver's timestamp columns are TIMESTAMP_NTZ; they are read as UTC instants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions.columns import safe_div
from barspark.schema import SEQ

BAR_ORDER = ["Timestamp", "Ticker", "Open", "High", "Low", "Close", "Volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _utc(c: str) -> Column:
    return F.col(c).cast("timestamp")


def _ohlcv(price: Column, order: Column, volume: Column) -> list[Column]:
    return [
        F.min_by(price, order).alias("Open"),
        F.max(price).alias("High"),
        F.min(price).alias("Low"),
        F.max_by(price, order).alias("Close"),
        volume.alias("Volume"),
    ]


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly OHLCV per event type; click/view trade on the India session, the rest in the US."""
    ev = table(spark, sf_dir, "events").select("event_id", _utc("ts").alias("ts"), "event_type", "value")
    ticker = F.concat(F.upper("event_type"),
                      F.when(F.col("event_type").isin("click", "view"), F.lit(".NS")).otherwise(F.lit("")))
    return (ev.groupBy(F.date_trunc("hour", "ts").alias("Timestamp"), ticker.alias("Ticker"))
            .agg(*_ohlcv(F.col("value"), F.struct("ts", "event_id"), F.count(F.lit(1)).cast("double")))
            .select(*BAR_ORDER, F.lit(0).cast("long").alias(SEQ)))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV of order totals per priority; priorities 1 and 2 trade on the India session."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", _utc("o_orderdate").alias("d"),
                                              "o_orderpriority")
    ticker = F.concat(F.upper(F.substring("o_orderpriority", 3, 3)),
                      F.when(F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2"),
                             F.lit(".NS")).otherwise(F.lit("")))
    return (o.groupBy(F.col("d").alias("Timestamp"), ticker.alias("Ticker"))
            .agg(*_ohlcv(F.col("o_totalprice"), F.col("o_orderkey"), F.count(F.lit(1)).cast("double")))
            .select(*BAR_ORDER, F.lit(0).cast("long").alias(SEQ)))


def bars_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier (many tickers, for scale): price = extended price / quantity."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
        safe_div("l_extendedprice", "l_quantity").alias("price"), _utc("l_shipdate").alias("d"))
    ticker = F.concat(F.col("l_suppkey").cast("string"),
                      F.when(F.col("l_suppkey") % 2 == 0, F.lit(".NS")).otherwise(F.lit("")))
    order = F.struct("l_orderkey", "l_linenumber", "price")
    return (li.groupBy(F.date_trunc("day", "d").alias("Timestamp"), ticker.alias("Ticker"))
            .agg(*_ohlcv(F.col("price"), order, F.sum("l_quantity")))
            .select(*BAR_ORDER, F.lit(0).cast("long").alias(SEQ)))


def bars_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars_hourly plus late duplicate copies, NULL closes and one all-NULL volume ticker."""
    base = bars_hourly(spark, sf_dir)
    copies = (base.filter(F.col("Volume") % 3 == 0)
              .withColumn("Close", F.col("Close") * F.lit(1.01))
              .withColumn(SEQ, F.lit(1).cast("long")))
    both = base.unionByName(copies)
    return (both.withColumn("Close", F.when(F.hour("Timestamp") % 7 != 0, F.col("Close")))
            .withColumn("Volume", F.when(F.col("Ticker") != "VIEW.NS", F.col("Volume"))))


def bars_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per ticker: {"points": [{timestamp, open, high, low, close, volume}, ...]}."""
    b = bars_hourly(spark, sf_dir)
    point = F.struct(F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
                     F.col("Open").alias("open"), F.col("High").alias("high"), F.col("Low").alias("low"),
                     F.col("Close").alias("close"), F.col("Volume").alias("volume"))
    return (b.groupBy("Ticker")
            .agg(F.to_json(F.struct(F.collect_list(point).alias("points"))).alias("payload"))
            .select(F.lower("Ticker").alias("ticker"), "payload"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch prediction requests: every ticker as of 2024-01-20 10:00, one NULL as_of, one unknown."""
    tickers = bars_hourly(spark, sf_dir).select("Ticker").distinct()
    dated = tickers.select(F.lower("Ticker").alias("ticker"),
                           F.lit("2024-01-20 10:00:00").cast("timestamp").alias("as_of"))
    latest = tickers.agg(F.min("Ticker").alias("t")).select(F.col("t").alias("ticker"),
                                                           F.lit(None).cast("timestamp").alias("as_of"))
    unknown = tickers.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ZZZZ.NS").alias("ticker"),
                                                              F.lit(None).cast("timestamp").alias("as_of"))
    return dated.unionByName(latest).unionByName(unknown)
