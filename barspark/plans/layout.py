"""One layout for cleaning: bars written once, clustered by (Ticker, time block), summed up block by block.

``bar_layout`` keeps the first copy of each bar with the number of its copies and writes the bars bucketed
by (Ticker, block). Everything later reads that table in place: gaps, summaries and windows run on
(Ticker, block) without a shuffle. Only ``block_summaries`` (one row per ticker and block) leave it; in
block order they say whether a ticker has daily bars and what is carried into each block.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark import config
from barspark.operators.market import in_session, is_weekday, local_time
from barspark.plans import series
from barspark.schema import SEQ
from barspark.session import materialize_clustered

BLK, COPIES, WEEK, SESSION = "_blk", "_copies", "_week", "_session"
KEYS = ["Ticker", BLK]
VARIANTS = {"w": WEEK, "s": SESSION}  # rows kept of a ticker with daily bars, and of any other


def bar_layout(df: DataFrame) -> DataFrame:
    """Bars without NULL ticker or stamp, first copy in input order, with ``_blk``, ``_copies`` and the flags
    ``_week`` and ``_session``. Copies are counted and cut before the shuffle, so a bar that
    a third of all rows repeat is one row per task; equal ``_seq`` go by the smallest values."""
    rest = [c for c in df.columns if c not in ("Ticker", "Timestamp")]
    kinds = dict(df.dtypes)
    rank = [c for c in sorted(rest, key=lambda c: c != SEQ) if not kinds[c].startswith(("map", "variant"))]
    d = df.filter(F.col("Ticker").isNotNull() & F.col("Timestamp").isNotNull()).withColumn(
        BLK, series.time_block(F.col("Timestamp"), series.block_seconds(df)))
    # The smallest row itself, unless it has columns that can't be compared: half as much to sort and shuffle.
    row = F.min(F.struct(*rank)) if len(rank) == len(rest) else F.min_by(F.struct(*rest), F.struct(*rank))
    first = d.groupBy(*KEYS, "Timestamp").agg(row.alias("_row"), F.count(F.lit(1)).alias(COPIES))
    local = local_time(F.col("Timestamp"), F.col("Ticker"))
    out = first.select(*KEYS, "Timestamp", "_row.*", COPIES, is_weekday(local).alias(WEEK)).withColumn(
        SESSION, F.col(WEEK) & in_session(local, F.col("Ticker")))
    return materialize_clustered(out, KEYS, [*KEYS, "Timestamp"])


def _seconds(stamp: Column) -> Column:
    return F.unix_micros(stamp) / 1e6


def block_summaries(layout: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per (Ticker, block): what its gaps say about the cadence, and for both sets of kept
    rows the first and last value of each column that isn't NULL."""
    daily = F.lit(float(config.DAILY_MEDIAN_GAP_SECONDS))
    w = Window.partitionBy(*KEYS).orderBy("Timestamp")
    d = layout.withColumn("_gap", _seconds(F.col("Timestamp")) - _seconds(F.lag("Timestamp").over(w)))
    short, gap = F.col("_gap") < daily, F.col("_gap")
    aggs = [F.count(F.lit(1)).alias("stamps"), F.sum(COPIES).alias("copies"), F.min("Timestamp").alias("from_ts"),
            F.max("Timestamp").alias("to_ts"), F.count_if(short).alias("short"), F.count_if(~short).alias("long"),
            F.max(F.when(short, gap)).alias("longest_short"), F.min(F.when(~short, gap)).alias("shortest_long")]
    for v, flag in VARIANTS.items():
        for i, c in enumerate(cols):
            at = F.when(F.col(flag) & F.col(c).isNotNull(), F.col("Timestamp"))
            aggs += [F.min_by(c, at).alias(f"head_{v}{i}"), F.max_by(c, at).alias(f"tail_{v}{i}")]
    return d.groupBy(*KEYS).agg(*aggs)


def with_is_daily(blocks: DataFrame) -> DataFrame:
    """Adds ``is_daily``: the median gap of the ticker's bars, copies as gaps of 0, is a daily one.

    The median is at or above the limit if both middle gaps are. If the limit lies between them, they are the
    longest gap below it and the shortest one at or above it. So counts and two extremes decide,
    exactly, and no task sorts or holds a ticker's gaps.
    """
    daily = F.lit(float(config.DAILY_MEDIAN_GAP_SECONDS))
    c = F.col
    before = Window.partitionBy("Ticker").orderBy(BLK)
    b = blocks.withColumn("_gap", _seconds(c("from_ts")) - _seconds(F.lag("to_ts").over(before)))
    whole = Window.partitionBy("Ticker")
    short = c("_gap") < daily
    repeated = c("copies") - c("stamps")
    b = b.withColumns({
        "_short": F.sum(c("short") + F.coalesce(short.cast("long"), F.lit(0)) + repeated).over(whole),
        "_long": F.sum(c("long") + F.coalesce((~short).cast("long"), F.lit(0))).over(whole),
        "_below": F.max(F.greatest("longest_short", F.when(short, c("_gap")), F.when(repeated > 0, 0.0))).over(whole),
        "_above": F.min(F.least("shortest_long", F.when(~short, c("_gap")))).over(whole)})
    last = c("_short") + c("_long") - 1  # middle places: floor and ceiling of last / 2
    lower, upper = F.floor(last / 2), F.ceil(last / 2)
    median_long = (F.when(lower >= c("_short"), True).when(upper < c("_short"), False)
                   .otherwise(c("_below") * 0.5 + c("_above") * 0.5 >= daily))
    return b.withColumn("is_daily", F.coalesce((last >= 0) & median_long, F.lit(False))).drop(
        "_gap", "_short", "_long", "_below", "_above")


def carries(blocks: DataFrame, cols: Sequence[str], scope: str = "ticker") -> DataFrame:
    """(Ticker, block, is_daily) and per column i ``_cf{i}``, the last value before the block, and ``_first{i}``,
    the ticker's first one; ``_gx{i}`` with ``scope="global"``: the first value of the next ticker by
    name that has one. Needs ``is_daily``.

    A bar is filled backward only if no value lies before it, and then the next value is the ticker's first.
    So no window looks ahead: one that did would read the rest of the series again for each row."""
    order = Window.partitionBy("Ticker").orderBy(BLK)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = lambda side, i: F.when(F.col("is_daily"), F.col(f"{side}_w{i}")).otherwise(F.col(f"{side}_s{i}"))
    n = range(len(cols))
    b = blocks.select(*KEYS, "is_daily", *[pick(side, i).alias(f"_{side}{i}") for side in ("head", "tail") for i in n])
    out = b.select(*KEYS, "is_daily", *[F.last(f"_tail{i}", ignorenulls=True).over(before).alias(f"_cf{i}") for i in n],
                   *[F.first(f"_head{i}", ignorenulls=True).over(whole).alias(f"_first{i}") for i in n])
    if scope != "global":
        return out
    firsts = out.groupBy("Ticker").agg(*[F.first(f"_first{i}").alias(f"_gx{i}") for i in n])
    return out.join(series.next_by_key(firsts, "Ticker", [f"_gx{i}" for i in n]), "Ticker", "left")


def filled(layout: DataFrame, carried: DataFrame, cols: Sequence[str], scope: str = "ticker") -> DataFrame:
    """The kept bars with NULLs filled forward, then backward: windows on (Ticker, block), carries beyond."""
    d = layout.join(carried, KEYS).filter((F.col("is_daily") & F.col(WEEK)) | F.col(SESSION))
    back = Window.partitionBy(*KEYS).orderBy("Timestamp").rowsBetween(Window.unboundedPreceding, 0)
    values = {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.col(f"_cf{i}"), F.col(f"_first{i}"),
                            *([F.col(f"_gx{i}")] if scope == "global" else [])) for i, c in enumerate(cols)}
    return d.select(*[values.get(c, F.col(c)).alias(c) for c in layout.columns])
