"""End-to-end properties on the driver tables (sf0.001) and chunking invariance."""

from pyspark.sql import functions as F

from barspark import config
from barspark.operators import cleaning, indicators, notebook
from barspark.operators.dataset import sequence_dataset
from barspark.schema import validate_features
from barspark.sources import fixtures as fx

from conftest import SF_SMALL


def rows(df, digits=6):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, digits) if isinstance(v, float) else v for v in r))
    return sorted(out, key=str)


def test_flagship_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    validate_features(df)
    n = df.count()
    assert n == 83  # session bars 44+41+40+34+34 = 193, minus 19 warm-up and 3 target rows per ticker
    assert df.filter(F.col("rsi") < 0).count() == 0


def test_session_filter_counts(spark):
    clean = cleaning.clean_market_data(fx.bars_hourly(spark, SF_SMALL))
    counts = {r["Ticker"]: r["count"] for r in clean.groupBy("Ticker").count().collect()}
    assert counts == {"CLICK.NS": 44, "ERROR": 41, "PURCHASE": 40, "SIGNUP": 34, "VIEW.NS": 34}


def test_chunking_invariance_package(spark, tiny_chunks):
    """Tiny chunks (7 rows, halos of hundreds of rows) must give exactly the one-chunk result."""
    clean = cleaning.clean_market_data(fx.bars_hourly(spark, SF_SMALL), materialize=False)
    small = rows(indicators.feature_frame(clean, materialize=False))
    spark.conf.unset(config.CHUNK_ROWS_CONF)
    spark.conf.unset(config.BLOCK_SECONDS_CONF)
    big = rows(indicators.feature_frame(cleaning.clean_market_data(fx.bars_hourly(spark, SF_SMALL), materialize=False),
                                        materialize=False))
    assert small == big


def test_chunking_invariance_notebook(spark, tiny_chunks):
    clean = cleaning.drop_invalid_prices(cleaning.clean_market_data(fx.bars_daily(spark, SF_SMALL), materialize=False))
    small = rows(notebook.notebook_features(clean, drop_nulls=False, materialize=False), 4)
    spark.conf.unset(config.CHUNK_ROWS_CONF)
    spark.conf.unset(config.BLOCK_SECONDS_CONF)
    clean2 = cleaning.drop_invalid_prices(cleaning.clean_market_data(fx.bars_daily(spark, SF_SMALL), materialize=False))
    big = rows(notebook.notebook_features(clean2, drop_nulls=False, materialize=False), 4)
    assert small == big


def test_sequence_window_counts(spark):
    """n - L + 1 windows per split; shapes L x 24 and 3 targets."""
    clean = cleaning.clean_market_data(fx.bars_hourly(spark, "/root/testdata/sf0.01"))
    f = indicators.feature_frame(clean)
    win, scaler, ids = sequence_dataset(f, L=48)
    per = {r["Ticker"]: r["count"] for r in f.groupBy("Ticker").count().collect()}
    expect = 0
    for n in per.values():
        cutoff = int(n * 0.8)
        expect += max(cutoff - 47, 0)
    assert win.filter("split = 'train'").count() == expect
    r = win.first()
    assert len(r["X"]) == 48 and len(r["X"][0]) == 24 and len(r["y"]) == 3
    sc = {r["feature"]: r["scale"] for r in scaler.collect()}
    assert len(sc) == 24 and all(v > 0 for v in sc.values())


def test_dedup_first_wins(spark):
    d = fx.bars_dirty(spark, SF_SMALL)
    from barspark.operators.market import dedup_first
    out = dedup_first(d)
    assert out.count() == fx.bars_hourly(spark, SF_SMALL).count()
    assert out.filter(F.col("_seq") == 1).count() == 0
