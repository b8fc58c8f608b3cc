"""Fill, drop and gate operators."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspark import config
from barspark.operators.market import dedup_first, filter_trading_hours
from barspark.plans import layout, series
from barspark.plans.series import CHUNK, RN
from barspark.schema import SEQ
from barspark.session import materialize as _materialize

__all__ = ["dedup_first", "ffill", "bfill", "fill_ohlcv", "drop_incomplete", "clean_market_data",
           "drop_invalid_prices", "select_existing", "drop_any_null", "drop_null_features",
           "fill_model_matrix", "numeric_features", "feature_cols", "normalize_ticker",
           "reject_unknown", "require_history", "fill_prices_report"]


def _indexed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = df if RN in df.columns else series.index_rows(df, keys)
    return series.with_chunks(d.drop(CHUNK) if CHUNK in d.columns else d)


def ffill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Last non-null value so far within the series (a chunked prefix scan; no whole-series task)."""
    keys = list(keys)
    d = _indexed(df, keys)
    w_local = Window.partitionBy(*keys, CHUNK).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.last(c, ignorenulls=True).over(w_local).alias(f"_ff_{c}") for c in cols])
    tails = d.groupBy(*keys, CHUNK).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(RN))).alias(f"_t_{c}")
                                         for c in cols])
    prior = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, CHUNK, *[F.last(f"_t_{c}", ignorenulls=True).over(prior).alias(f"_cf_{c}")
                                         for c in cols])
    d = d.join(carry, [*keys, CHUNK], "left")
    return d.withColumns({c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_cf_{c}")) for c in cols}).drop(
        *[f"_ff_{c}" for c in cols], *[f"_cf_{c}" for c in cols])


def bfill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("Ticker",), scope: str = "ticker") -> DataFrame:
    """Next non-null value within the series.

    ``scope="global"`` reproduces an ungrouped back-fill over the ticker-ordered frame: a ticker
    that is still all-NULL takes the first value of the next ticker (by name) that has one. That
    is resolved on a one-row-per-ticker table, never by sorting the bars globally.
    """
    keys = list(keys)
    d = _indexed(df, keys)
    w_local = Window.partitionBy(*keys, CHUNK).orderBy(RN).rowsBetween(0, Window.unboundedFollowing)
    d = d.select("*", *[F.first(c, ignorenulls=True).over(w_local).alias(f"_bf_{c}") for c in cols])
    heads = d.groupBy(*keys, CHUNK).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(RN))).alias(f"_h_{c}")
                                         for c in cols])
    later = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
    carry = heads.select(*keys, CHUNK, *[F.first(f"_h_{c}", ignorenulls=True).over(later).alias(f"_cb_{c}")
                                         for c in cols])
    d = d.join(carry, [*keys, CHUNK], "left")
    d = d.withColumns({c: F.coalesce(F.col(f"_bf_{c}"), F.col(f"_cb_{c}")) for c in cols}).drop(
        *[f"_bf_{c}" for c in cols], *[f"_cb_{c}" for c in cols])
    if scope == "global":
        firsts = heads.groupBy(*keys).agg(*[F.min_by(F.col(f"_h_{c}"), F.when(F.col(f"_h_{c}").isNotNull(), F.col(CHUNK)))
                                            .alias(f"_fx_{c}") for c in cols])
        d = d.join(_next_series(firsts, keys, cols), keys, "left")
        d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"_gx_{c}")) for c in cols}).drop(*[f"_gx_{c}" for c in cols])
    return d


def _next_series(firsts: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``_gx_c``: the value ``_fx_c`` of the next series by key that has one."""
    one = firsts.withColumn("_key", F.struct(*keys)).select("_key", *[F.col(f"_fx_{c}").alias(f"_gx_{c}") for c in cols])
    return series.next_by_key(one, "_key", [f"_gx_{c}" for c in cols]).select("_key.*", *[f"_gx_{c}" for c in cols])


def fill_ohlcv(df: DataFrame, scope: str = "ticker", cols: Sequence[str] = tuple(config.PRICE_COLUMNS),
               keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """B10 then B11 in one pass: a back-fill after a forward-fill only touches leading NULLs, so
    the result is coalesce(last non-null so far, next non-null from here). Both directions share
    one Window node, one per-chunk summary, one carry window and one join back."""
    keys = list(keys)
    d = _indexed(df, keys)
    base = Window.partitionBy(*keys, CHUNK).orderBy(RN)
    wf = base.rowsBetween(Window.unboundedPreceding, 0)
    wb = base.rowsBetween(0, Window.unboundedFollowing)
    d = d.select("*", *[F.last(c, ignorenulls=True).over(wf).alias(f"_ff_{c}") for c in cols],
                 *[F.first(c, ignorenulls=True).over(wb).alias(f"_bf_{c}") for c in cols])
    pos = lambda c: F.when(F.col(c).isNotNull(), F.col(RN))
    summ = d.groupBy(*keys, CHUNK).agg(*[F.max_by(F.col(c), pos(c)).alias(f"_t_{c}") for c in cols],
                                       *[F.min_by(F.col(c), pos(c)).alias(f"_h_{c}") for c in cols])
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    prior = chunks.rowsBetween(Window.unboundedPreceding, -1)
    later = chunks.rowsBetween(1, Window.unboundedFollowing)
    carry = summ.select(*keys, CHUNK, *[f"_h_{c}" for c in cols],
                        *[F.last(f"_t_{c}", ignorenulls=True).over(prior).alias(f"_cf_{c}") for c in cols],
                        *[F.first(f"_h_{c}", ignorenulls=True).over(later).alias(f"_cb_{c}") for c in cols])
    d = d.join(carry.drop(*[f"_h_{c}" for c in cols]), [*keys, CHUNK], "left")
    d = d.withColumns({c: F.coalesce(F.col(f"_ff_{c}"), F.col(f"_cf_{c}"), F.col(f"_bf_{c}"), F.col(f"_cb_{c}"))
                       for c in cols})
    d = d.drop(*[f"_{p}_{c}" for p in ("ff", "cf", "bf", "cb") for c in cols])
    if scope == "global":
        # A ticker still all-NULL takes the first value of the next ticker (by name) with one,
        # resolved on a one-row-per-ticker table.
        firsts = summ.groupBy(*keys).agg(*[F.min_by(F.col(f"_h_{c}"), F.when(F.col(f"_h_{c}").isNotNull(), F.col(CHUNK)))
                                           .alias(f"_fx_{c}") for c in cols])
        d = d.join(_next_series(firsts, keys, cols), keys, "left")
        d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"_gx_{c}")) for c in cols}).drop(*[f"_gx_{c}" for c in cols])
    return d


def drop_incomplete(df: DataFrame, cols: Sequence[str] = tuple(config.PRICE_COLUMNS)) -> DataFrame:
    """Drop bars with a NULL price/volume."""
    return df.na.drop(subset=list(cols))


def clean_market_data(df: DataFrame, scope: str = "ticker", cadence: DataFrame | None = None,
                      materialize: bool = True) -> DataFrame:
    """B13 = B08 (filter + dedup) -> B10 ffill -> B11 bfill -> B12 drop, on one layout (plans/layout.py).

    The input is read once, into a table clustered by (Ticker, block). ``cadence`` (Ticker, is_daily) may be
    passed in. The clean table is a published artifact (A16) and is read by every later stage, so it is
    written by default."""
    cols = list(config.PRICE_COLUMNS)
    bars = layout.bar_layout(df)
    blocks = layout.block_summaries(bars, cols)
    if cadence is None:
        blocks = layout.with_is_daily(blocks)
    else:
        blocks = blocks.join(cadence.select("Ticker", "is_daily"), "Ticker", "left")
    out = drop_incomplete(layout.filled(bars, layout.carries(blocks, cols, scope), cols, scope))
    out = out.select(*[c for c in df.columns if c != SEQ])
    return _materialize(out) if materialize else out


def drop_invalid_prices(df: DataFrame, col: str = "Close") -> DataFrame:
    """Remove bars whose close is not positive."""
    return df.filter(F.col(col) > 0)


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Project the requested columns that exist."""
    return df.select(*[c for c in cols if c in df.columns])


def drop_any_null(df: DataFrame) -> DataFrame:
    """B17."""
    return df.na.drop(how="any")


def drop_null_features(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL in any non-target column."""
    return df.na.drop(subset=[c for c in df.columns if "Target" not in c])


def fill_model_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Forward fill inside each (key...) series, then 0."""
    return ffill(df, cols, keys).fillna(0.0, subset=list(cols)).drop(CHUNK)


def numeric_features(df: DataFrame, target: str | None = None, exclude_targets: bool = True) -> list[str]:
    """Numeric columns minus the target (and, by default, minus every *Target* column)."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes
            if (t in numeric or t.startswith("decimal")) and c != target and not c.startswith("_")
            and not (exclude_targets and "Target" in c)]


def feature_cols(df: DataFrame) -> list[str]:
    """Everything except stamps, tickers and targets."""
    skip = {"Timestamp", "Date", "Ticker", "_seq"}
    return [c for c in df.columns if c not in skip and "Target" not in c and not c.startswith("target_")]


def normalize_ticker(df: DataFrame, col: str = "Ticker") -> DataFrame:
    """B22."""
    return df.withColumn(col, F.upper(F.col(col)))


def reject_unknown(requests: DataFrame, known: DataFrame, col: str = "Ticker") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected-with-reason) against the known ticker table (one row per ticker)."""
    k = known.select(col).distinct()
    accepted = requests.join(k, col, "left_semi")
    rejected = requests.join(k, col, "left_anti").withColumn("reason", F.lit("unknown ticker"))
    return accepted, rejected


def require_history(df: DataFrame, n: int, keys: Sequence[str] = ("Ticker",)) -> tuple[DataFrame, DataFrame]:
    """Series with at least ``n`` rows pass; the others are listed with their count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    ok = counts.filter(F.col("n_rows") >= n).select(*keys)
    short = counts.filter(F.col("n_rows") < n).withColumn("reason", F.lit(f"fewer than {n} rows"))
    return df.join(ok, list(keys), "left_semi"), short


def fill_prices_report(before: DataFrame, cols: Sequence[str] = tuple(config.PRICE_COLUMNS),
                       scope: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """Fill, and report per column how many NULLs were filled."""
    filled = fill_ohlcv(before, scope=scope, cols=cols)
    nb = before.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    na = filled.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    stack = lambda d, tag: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(tag)) for c in cols])).alias("s")).select("s.*")
    report = stack(nb, "nulls_before").join(stack(na, "nulls_after"), "column").withColumn(
        "filled", F.col("nulls_before") - F.col("nulls_after"))
    return filled, report
