"""Source/sink and serving queries (A, B22-B24, C rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark import config as C
from barspark.functions.columns import output
from barspark.operators import cleaning, serving
from barspark.plans import sql as S
from barspark.plans.q_features import features, package_features_sql
from barspark.plans.registry import query
from barspark.sources import bars_io as io
from barspark.sources import fixtures as fx

BAR_OUT = '"Timestamp", Ticker, ' + S.rcols(C.PRICE_COLUMNS)


def _bars(df):
    return output(df.select(*C.BAR_COLUMNS))


@query("A01_normalize_vendor_frame", S.with_views(f"SELECT {BAR_OUT} FROM bars", [("bars", S.BARS_DAILY)]))
def q_normalize(spark, sf_dir):
    """Vendor-shaped frame (lower-case names, 'date', extra 'adj close') -> the 7-column bar table."""
    b = fx.bars_daily(spark, sf_dir)
    vendor = b.select(F.col("Timestamp").alias("date"), F.lower("Ticker").alias("ticker"), F.col("Open").alias("open"),
                      F.col("High").alias("high"), F.col("Low").alias("low"), F.col("Close").alias("close"),
                      F.col("Close").alias("adj close"), F.col("Volume").alias("volume"))
    return _bars(io.normalize_bars(vendor))


@query("A02_bars_from_json_payload", S.with_views(f"SELECT {BAR_OUT} FROM bars", [("bars", S.BARS_HOURLY)]))
def q_json(spark, sf_dir):
    """One JSON document per ticker -> bars (payload parse, point explode, rename, upper ticker, UTC)."""
    bars, _ = io.bars_from_json(fx.bars_payload(spark, sf_dir))
    return _bars(bars)


@query("A02_empty_payloads", S.with_views(
    "SELECT DISTINCT Ticker, 'no bar data returned' AS error FROM bars WHERE Ticker LIKE '%.NS'", [("bars", S.BARS_HOURLY)]))
def q_json_empty(spark, sf_dir):
    """Payloads without points (empty list, missing list, no document at all) are reported, not dropped."""
    p = fx.bars_payload(spark, sf_dir)
    blank = F.when(F.col("ticker").startswith("c"), F.lit('{"points": []}')).otherwise(F.lit("{}"))
    _, empty = io.bars_from_json(p.withColumn("payload", F.when(F.col("ticker").endswith(".ns"), blank).otherwise(F.col("payload"))))
    return output(empty)


@query("A03_A05_csv_round_trip", S.with_views(f"SELECT {BAR_OUT} FROM bars", [("bars", S.BARS_DAILY)]))
def q_csv(spark, sf_dir):
    """CSV sink (header, ISO stamps) and the CSV scan that finds the date column and parses it."""
    b = fx.bars_daily(spark, sf_dir).select(F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("Date"),
                                            "Ticker", "Open", "High", "Low", "Close", "Volume")
    path = io.write_table(b, io.scratch_path(spark, "csv"), fmt="csv", partition_by=())
    return _bars(io.read_bars_csv(spark, path))


@query("A04_parquet_round_trip", S.with_views(f"SELECT {BAR_OUT} FROM bars", [("bars", S.BARS_SUPPLIER)]))
def q_parquet(spark, sf_dir):
    """Ticker-partitioned parquet sink and scan (``read_table`` prunes partitions by Ticker)."""
    path = io.write_table(fx.bars_supplier(spark, sf_dir).select(*C.BAR_COLUMNS), io.scratch_path(spark, "parquet"))
    return _bars(io.read_table(spark, path))


@query("A08_I01_union_bars", S.with_views(
    f"SELECT {BAR_OUT} FROM (SELECT * FROM h UNION ALL SELECT * FROM d) u", [("h", S.BARS_HOURLY), ("d", S.BARS_DAILY)]))
def q_union(spark, sf_dir):
    return _bars(io.union_bars(spark, [fx.bars_hourly(spark, sf_dir), fx.bars_daily(spark, sf_dir)]))


REQ_SQL = """SELECT lower(t) AS ticker, TIMESTAMP '2024-01-20 10:00:00' AS as_of FROM (SELECT DISTINCT Ticker AS t FROM h) a
UNION ALL SELECT min(Ticker), NULL FROM h
UNION ALL SELECT 'ZZZZ.NS', NULL"""


@query("A09_C07_missing_tickers", S.with_views(
    "SELECT DISTINCT upper(ticker) AS Ticker FROM req WHERE upper(ticker) NOT IN (SELECT Ticker FROM h)",
    [("h", S.BARS_HOURLY), ("req", REQ_SQL)]))
def q_missing(spark, sf_dir):
    req = cleaning.normalize_ticker(fx.requests(spark, sf_dir).withColumnRenamed("ticker", "Ticker"))
    return output(io.missing_tickers(req, fx.bars_hourly(spark, sf_dir)))


@query("A10_prefer_source", S.with_views(f"""
SELECT {BAR_OUT}, src AS source_rank FROM (
  SELECT *, min(src) OVER (PARTITION BY Ticker) AS best FROM (
    SELECT *, 0 AS src FROM h UNION ALL SELECT *, 1 FROM d UNION ALL SELECT *, 2 FROM dirty) u) x WHERE src = best""",
    [("h", S.BARS_HOURLY), ("d", S.BARS_DAILY), ("dirty", S.BARS_DIRTY)]))
def q_prefer(spark, sf_dir):
    """Ranked sources (hourly, daily, dirty copy of hourly): each ticker from its best source."""
    out = io.prefer_source([fx.bars_hourly(spark, sf_dir), fx.bars_daily(spark, sf_dir), fx.bars_dirty(spark, sf_dir)])
    return output(out.select(*C.BAR_COLUMNS, F.col("source_rank").cast("int").alias("source_rank")))


@query("A11_trim_period", S.with_views(f"""
SELECT {BAR_OUT} FROM d JOIN (SELECT Ticker, max("Timestamp") AS l FROM d GROUP BY Ticker) m USING (Ticker)
WHERE "Timestamp" >= l - INTERVAL 6 MONTH""", [("d", S.BARS_DAILY)]))
def q_trim(spark, sf_dir):
    return _bars(io.trim_period(fx.bars_daily(spark, sf_dir), "6mo"))


@query("A12_latest_n_bars", S.with_views(f"""
SELECT {BAR_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY "Timestamp" DESC) AS k FROM s) x
WHERE k <= {max(6 * C.SEQUENCE_LENGTH, 240)}""", [("s", S.BARS_SUPPLIER)]))
def q_latest_n(spark, sf_dir):
    return _bars(io.latest_n_bars(fx.bars_supplier(spark, sf_dir)))


@query("B01_B02_as_of_cutoff", S.with_views(
    f"SELECT {BAR_OUT} FROM h WHERE \"Timestamp\" <= TIMESTAMP '2024-01-20 10:00:00'", [("h", S.BARS_HOURLY)]))
def q_as_of(spark, sf_dir):
    from barspark.operators import market
    return _bars(market.as_of(fx.bars_hourly(spark, sf_dir), "2024-01-20 10:00:00"))


@query("B22_B23_request_gate", S.with_views("""
SELECT upper(ticker) AS Ticker, as_of, upper(ticker) IN (SELECT Ticker FROM h) AS accepted,
       CASE WHEN upper(ticker) IN (SELECT Ticker FROM h) THEN NULL ELSE 'unknown ticker' END AS reason
FROM req""", [("h", S.BARS_HOURLY), ("req", REQ_SQL)]))
def q_gate(spark, sf_dir):
    req = cleaning.normalize_ticker(fx.requests(spark, sf_dir).withColumnRenamed("ticker", "Ticker"))
    acc, rej = cleaning.reject_unknown(req, fx.bars_hourly(spark, sf_dir))
    out = acc.withColumns({"accepted": F.lit(True), "reason": F.lit(None).cast("string")}).unionByName(
        rej.withColumn("accepted", F.lit(False)))
    return output(out.select("Ticker", "as_of", "accepted", "reason"))


@query("B24_require_history", S.with_views(f"""
SELECT Ticker, count(*) AS n_rows, count(*) >= 150 AS enough_history FROM f GROUP BY Ticker""",
    [("f", package_features_sql("hourly", rounded=False))]))
def q_history(spark, sf_dir):
    """Tickers with at least 150 feature rows pass; the others are listed with their count."""
    f = features(spark, sf_dir)
    ok, short = cleaning.require_history(f, 150)
    counts = f.groupBy("Ticker").agg(F.count(F.lit(1)).alias("n_rows"))
    return output(counts.join(ok.select("Ticker").distinct().withColumn("enough_history", F.lit(True)), "Ticker", "left")
                  .fillna(False, subset=["enough_history"]))


@query("C06_asof_request_join", S.with_views("""
SELECT Ticker, as_of, CAST(request AS INTEGER) AS request, count(*) AS n_bars, min("Timestamp") AS first_ts, max("Timestamp") AS last_ts FROM (
  SELECT upper(r.ticker) AS Ticker, r.as_of, r.request, b."Timestamp",
         row_number() OVER (PARTITION BY upper(r.ticker), r.as_of, r.request ORDER BY b."Timestamp" DESC) AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY upper(ticker), as_of ORDER BY 1) AS request FROM (SELECT * FROM req UNION ALL SELECT * FROM req) q) r
  JOIN cleaned b ON b.Ticker = upper(r.ticker) AND (r.as_of IS NULL OR b."Timestamp" <= r.as_of)) x
WHERE k <= 100 GROUP BY 1, 2, 3""", [("h", S.BARS_HOURLY), ("bars", S.BARS_HOURLY), ("cleaned", S.clean("bars")), ("req", REQ_SQL)]))
def q_asof(spark, sf_dir):
    """Each request's newest 100 clean bars at or before its as_of (NULL = latest); every request is asked twice."""
    req = cleaning.normalize_ticker(fx.requests(spark, sf_dir).withColumnRenamed("ticker", "Ticker"))
    req = req.unionByName(req)
    bars = cleaning.clean_market_data(fx.bars_hourly(spark, sf_dir))
    j = serving.asof_bars(req, bars, n=100)
    return output(j.groupBy("Ticker", "as_of", "request").agg(F.count(F.lit(1)).alias("n_bars"), F.min("Timestamp").alias("first_ts"),
                                                   F.max("Timestamp").alias("last_ts")))
