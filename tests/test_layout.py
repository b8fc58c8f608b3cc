"""Cleaning on one layout against the operators it is made of, and the shape of its plan."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from barspark import config
from barspark.operators import cleaning, market
from barspark.plans import layout, series
from barspark.sources import fixtures as fx

from conftest import SF_SMALL

BARS = "Timestamp timestamp, Ticker string, Open double, High double, Low double, Close double, Volume double, _seq long, note map<string,int>"
DAY = dt.timedelta(days=1)


def random_bars(seed):
    """Hourly and daily tickers, copies, one hot copied bar, NULL prices, an all-NULL column, NULL keys, one bar."""
    rng = random.Random(seed)
    out = []
    for t, step, n in (("HOT", dt.timedelta(hours=1), 500), ("D.NS", DAY, 60), ("Z", DAY, 40), ("ONE", DAY, 1), ("MIX", dt.timedelta(hours=7), 90)):
        at = dt.datetime(2024, 1, 1, 4)
        for i in range(n):
            price = lambda: None if rng.random() < 0.3 else float(rng.randint(1, 99))
            for k in range(rng.choice([1, 1, 1, 2, 3]) + (400 if t == "HOT" and i == 50 else 0)):
                volume = None if t in ("D.NS", "ONE") else price()
                out.append((at, t, price(), price(), price(), price(), volume, len(out), {"k": k}))
            at += step * rng.choice([1, 1, 1, 4])
    out += [(None, "HOT", 1.0, 1.0, 1.0, 1.0, 1.0, -1, None), (dt.datetime(2024, 1, 2), None, 1.0, 1.0, 1.0, 1.0, 1.0, -2, None)]
    rng.shuffle(out)
    return out


def values(df):
    return sorted(tuple(r[c] for c in config.BAR_COLUMNS) for r in df.collect())


@pytest.mark.parametrize("scope", ["ticker", "global"])
def test_layout_equals_the_steps(spark, tiny_chunks, scope):
    df = spark.createDataFrame(random_bars(3), BARS).repartition(6)
    want = cleaning.drop_incomplete(cleaning.fill_ohlcv(market.filter_trading_hours(df.drop("note")), scope=scope))
    got = cleaning.clean_market_data(df, scope=scope, materialize=False)
    assert got.columns == [c for c in df.columns if c != "_seq"]
    assert values(got) == values(want) and got.count() > 100
    given = market.bar_cadence(df)
    assert values(cleaning.clean_market_data(df, scope=scope, cadence=given)) == values(want)


def test_is_daily_without_a_median(spark, tiny_chunks):
    """The limit between, on and beside the middle gaps; copies as gaps of 0."""
    hours = {"LOW": [19, 19, 21], "HIGH": [19, 21, 21], "EVEN_AT": [10, 30], "EVEN_UNDER": [10, 29], "EVEN_BOTH": [1, 20, 20, 90],
             "ON": [20], "UNDER": [19.9], "ONE": [], "FAR": [500, 1, 600, 700], "COPIED": [24, 24, 0, 0, 0], "COPIED_LESS": [24, 24, 24, 0, 0]}
    rows = []
    for t, gaps in hours.items():
        at = dt.datetime(2024, 1, 1)
        for g in [0, *gaps]:
            at += dt.timedelta(hours=g)
            rows.append((at, t, 1.0, 1.0, 1.0, 1.0, 1.0, len(rows), None))
    df = spark.createDataFrame(rows, BARS)
    blocks = layout.with_is_daily(layout.block_summaries(layout.bar_layout(df), ["Close"]))
    got = {r.Ticker: r.is_daily for r in blocks.select("Ticker", "is_daily").distinct().collect()}
    assert got == {r.Ticker: r.is_daily for r in market.bar_cadence(df).collect()}
    assert got["EVEN_AT"] and not got["EVEN_UNDER"] and not got["COPIED"] and got["COPIED_LESS"] and not got["ONE"]


def test_equal_input_positions_go_by_value(spark):
    rows = [(dt.datetime(2024, 1, 2, 16), "A", float(k), 1.0, 1.0, 1.0, 1.0, 0, None) for k in range(9)]
    for n in (1, 5):
        df = spark.createDataFrame(rows, BARS).repartition(n)
        assert [r.Open for r in layout.bar_layout(df).collect()] == [0.0]


def test_empty(spark):
    assert cleaning.clean_market_data(spark.createDataFrame([], BARS), scope="global").count() == 0


def test_bars_are_shuffled_for_the_layout_only(spark, tmp_path):
    """The layout's write takes two shuffles of bars; cleaning reads it in place: what it shuffles is block rows."""
    fx.bars_hourly(spark, SF_SMALL).write.parquet(str(tmp_path / "bars"))
    df = spark.read.parquet(str(tmp_path / "bars"))
    out = cleaning.clean_market_data(df, materialize=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cleaning.clean_market_data(df, materialize=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # block rows by Ticker; carries to (Ticker, block)
    assert len(re.findall(r"FileScan", plan)) == 2 and "tmp_path" not in plan and str(tmp_path) not in plan
    assert out.count() == 193


def test_no_window_reads_the_rest_of_a_series_for_each_row(spark):
    """Backward fills come from the ticker's first value: a frame from a row to the end costs the square of the rows."""
    df = spark.createDataFrame(random_bars(5), BARS)
    plan = cleaning.clean_market_data(df, materialize=False)._jdf.queryExecution().analyzed().toString()
    frames = re.findall(r"specifiedwindowframe\(RowFrame, (.*?), unboundedfollowing", plan)
    assert frames and all(f.startswith("unboundedpreceding") for f in frames)


def test_numbers_and_next_values_by_key(spark):
    rows = [(f"k{i:04d}", float(i) if i % 7 == 0 and i < 900 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.n for r in series.number_by_key(df.select("k"), "k", "n").collect()}
    assert got == {k: i for i, (k, _) in enumerate(rows)}
    want = {k: next((w for _, w in rows[i + 1:] if w is not None), None) for i, (k, _) in enumerate(rows)}
    assert {r.k: r.v for r in series.next_by_key(df, "k", ["v"]).collect()} == want
