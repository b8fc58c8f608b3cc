"""Requests turned into positions: same answers as joining the history, at most 2n rows read a request."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barspark import config as C
from barspark.operators import serving
from barspark.plans import series

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    hour = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int))")
    hot = spark.range(5000).where("id < 1000 or id > 2000").select(F.lit("HOT").alias("Ticker"), hour.alias("Timestamp"), F.col("id").cast("double").alias("Close"))
    return hot.unionByName(spark.range(7).select(F.lit("FEW"), hour, F.col("id").cast("double")).toDF("Ticker", "Timestamp", "Close"))


def requests(spark, n):
    hot = spark.range(n).select(F.lit("HOT").alias("Ticker"), F.expr(
        "timestamp'2023-12-31 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(pmod(id * 7919, 330000) as int))").alias("as_of"))
    odd = spark.createDataFrame([("FEW", None), ("FEW", START), ("FEW", START), ("NONE", None), (None, None), ("HOT", None),
                                 ("HOT", dt.datetime(2200, 1, 1)), ("FEW", START - dt.timedelta(1))], "Ticker string, as_of timestamp")
    return hot.unionByName(odd)


@pytest.mark.parametrize("per_task", [100_000, 50])
def test_same_answers_as_the_history_join(spark, bars, per_task, monkeypatch):
    monkeypatch.setattr(serving, "ASKS_PER_TASK", per_task)
    req = requests(spark, 10_000)
    got = {(r.Ticker, r.as_of): r["_end"] for r in serving.asof_positions(req.distinct(), bars).collect()}
    b = {t: sorted(r.Timestamp for r in bars.where(F.col("Ticker") == t).collect()) for t in ("HOT", "FEW")}
    asked = {(r.Ticker, r.as_of) for r in req.collect() if r.Ticker}
    from bisect import bisect_right
    assert got == {(t, a): bisect_right(b.get(t, []), a) if a else len(b.get(t, [])) for t, a in asked}


def test_newest_bars_of_every_request(spark, bars):
    req = requests(spark, 500)
    for n in (1, 10):
        got = serving.asof_bars(req, bars, n).groupBy("Ticker", "as_of", "request").agg(F.sort_array(F.collect_list("Close")).alias("c"))
        every = serving.asof_bars(req, bars).groupBy("Ticker", "as_of", "request").agg(F.sort_array(F.collect_list("Close")).alias("c"))
        every = every.withColumn("c", F.sort_array(F.slice(F.reverse("c"), 1, n)))
        order = lambda d: sorted(map(tuple, d.collect()), key=str)
        assert order(got) == order(every)


def test_rows_read_by_a_request_are_bounded(spark, bars):
    n = 20
    placed = serving.asof_positions(requests(spark, 10_000).distinct(), bars)
    read = serving.asof_pairs(placed, series.index_rows(bars), n).groupBy("Ticker", "as_of").count().agg(F.max("count")).first()[0]
    assert n <= read <= 2 * n


def test_every_request_is_answered_or_rejected(spark, bars):
    sigma = spark.createDataFrame([(1.0, 1.0)], "rmse double, mae double")
    req = requests(spark, 300)
    predict = lambda d: d.withColumn("predictions", F.array(*[F.col("Close")] * C.HORIZON))
    done, rejected = serving.predict_batch(req, bars, predict, sigma, ["Close"], seq_len=4)
    assert done.count() + rejected.count() == req.count()
    times = sorted(r.Timestamp for r in bars.where("Ticker = 'HOT'").collect())
    for r in done.where("ticker = 'HOT'").collect():
        known = [t for t in times if r.as_of is None or t <= r.as_of]
        assert r.feature_ts == known[-C.HORIZON - 1]
    reasons = {(r.Ticker, r.reason) for r in rejected.where("Ticker is null or Ticker <> 'HOT'").collect()}
    assert reasons == {("FEW", "fewer than 4 feature rows"), ("NONE", "unknown ticker"), (None, "unknown ticker")}


def test_empty_inputs(spark, bars):
    req = requests(spark, 5)
    assert serving.asof_bars(req.limit(0), bars, 3).count() == 0
    assert serving.asof_bars(req, bars.limit(0), 3).count() == 0
