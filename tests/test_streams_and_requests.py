"""Streams under different micro-batches, repeated requests, ingest contract, hand-made bar table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barspark import config as C
from barspark.operators import cleaning, indicators, market, serving
from barspark.plans import q_streaming
from barspark.schema import SchemaError
from barspark.sources import bars_io as io
from barspark.streaming import streams

START = dt.datetime(2024, 1, 1, 15, 0)


def bars(spark, n=41, tickers=("AAA", "BBB")):
    rows = [(START + dt.timedelta(hours=i), t, 100.0 + (i * 7 % 11) + k, 1) for k, t in enumerate(tickers) for i in range(n)]
    return spark.createDataFrame(rows, "Timestamp timestamp, Ticker string, Close double, _seq long")


def streamed(spark, parts, name, per_batch):
    src = io.scratch_path(spark, name)
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", per_batch).parquet(src)


def halves(df):
    cut = F.lit(START + dt.timedelta(hours=20))
    return [df.filter(F.col("Timestamp") >= cut), df.filter(F.col("Timestamp") < cut)]  # the newer file first


def table(spark, stream, name, keys=("Timestamp", "Ticker")):
    path = streams.run_to_table(spark, stream, name, mode="update")
    rows = streams.read_stream_table(spark, path, list(keys)).drop("_batch").collect()
    return sorted(tuple(None if isinstance(v, float) and v != v else v for v in r) for r in rows)


def test_indicators_do_not_depend_on_batches(spark):
    df = bars(spark)
    one = table(spark, streams.indicator_stream(streamed(spark, [df], "one", 10)), "t-one")
    two = table(spark, streams.indicator_stream(streamed(spark, halves(df), "two", 1)), "t-two")
    assert len(one) == 82 and not any(r[-1] for r in one)
    assert str(one) == str(two)


def test_late_bars_are_reported(spark):
    df = bars(spark, 41, ("AAA",))
    parts = [*halves(df), bars(spark, 60, ("AAA",)).filter(F.col("Timestamp") >= F.lit(START + dt.timedelta(hours=41)))]
    stream = streams.indicator_stream(streamed(spark, [parts[0], parts[2], parts[1]], "late", 1), watermark="1 hour")
    rows = table(spark, stream, "t-late")
    assert len(rows) == 60 and sum(r[-1] for r in rows) == 20


def test_first_copy_wins_in_any_batch_order(spark):
    day = dt.datetime(2024, 1, 3, 15, 0)
    first = spark.createDataFrame([(day, "AAA", 1.0, 0)], "Timestamp timestamp, Ticker string, Close double, _seq long")
    later = spark.createDataFrame([(day, "AAA", 2.0, 5)], first.schema)
    cadence = spark.createDataFrame([("AAA", True)], "Ticker string, is_daily boolean")
    for parts in ([first, later], [later, first]):
        got = table(spark, streams.clean_stream(streamed(spark, parts, "copies", 1), cadence), "t-copies")
        assert [r[2] for r in got] == [1.0]


def test_upsert_keeps_all_tickers(spark):
    parts = [bars(spark, 3 + k, (t,)) for k, t in enumerate("ABCDE")]
    stream = streams.indicator_stream(streamed(spark, parts, "upsert", 1)).where("not is_late")
    path = streams.run_to_table(spark, stream, "t-upsert", mode="update", upsert_keys=["Ticker"])
    got = {r.Ticker: r.Timestamp for r in streams.read_stream_table(spark, path).collect()}
    assert got == {t: START + dt.timedelta(hours=2 + k) for k, t in enumerate("ABCDE")}


def test_replayed_slices_cover_all_rows(spark):
    df = bars(spark)
    path = streams.run_to_table(spark, q_streaming.replayed(spark, df, "slices"), "t-slices")
    assert spark.read.parquet(path).drop("_batch").count() == df.count()


def test_repeated_requests_get_whole_answers(spark):
    req = spark.createDataFrame([("AAA", None), ("AAA", None), ("AAA", START), ("ZZZ", None)], "Ticker string, as_of timestamp")
    got = serving.asof_bars(req, bars(spark), n=10).groupBy("as_of", "request").count().collect()
    assert sorted((r.as_of is None, r.request, r["count"]) for r in got) == [(False, 1, 1), (True, 1, 10), (True, 2, 10)]


def test_ingest_order_nan_and_missing_columns(spark):
    raw = spark.createDataFrame([("2024-01-02", "aa", 1.0, 2.0, 0.5, float("nan"), 10.0), ("2024-01-02", "aa", 1.0, 2.0, 0.5, 1.5, 10.0)],
                                ["Date", "Ticker", "Open|AA", "High|AA", "Low|AA", "Close|AA", "Volume|AA"]).coalesce(1)
    raw = raw.withColumn("Date", F.to_timestamp("Date"))
    out = io.normalize_bars(raw)
    assert out.columns == [*C.BAR_COLUMNS, "_seq"]
    assert market.dedup_first(out).select("Close", "Ticker").collect() == [(None, "AA")]
    with pytest.raises(Exception, match="Close|missing|UNRESOLVED"):
        io.normalize_bars(raw.drop("Close|AA")).collect()
    assert issubclass(SchemaError, ValueError)


def test_ticker_is_only_upper_cased(spark):
    df = spark.createDataFrame([(" aa",)], "Ticker string")
    assert cleaning.normalize_ticker(df).first().Ticker == " AA"


def test_linear_bars_give_98_feature_rows(spark):
    days = [d for d in (dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)) if d.weekday() < 5][:20]
    stamps = [dt.datetime(d.year, d.month, d.day, h) - dt.timedelta(minutes=330) for d in days for h in range(9, 16)]  # Kolkata clock
    n = len(stamps)
    line = lambda a, b, i: a + (b - a) * i / (n - 1)
    rows = [(t, "TATAMOTORS.NS", line(100, 180, i), line(101, 181, i), line(99, 179, i), line(100, 180, i), line(1000, 2000, i), i)
            for i, t in enumerate(stamps)]
    df = spark.createDataFrame(rows, "Timestamp timestamp, Ticker string, Open double, High double, Low double, Close double, Volume double, _seq long")
    clean = cleaning.clean_market_data(df)
    assert (n, clean.count()) == (140, 120)
    assert indicators.feature_frame(clean).count() == 98
