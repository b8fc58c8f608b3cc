"""Skew-safe ordered processing of many time series.

A per-ticker ``Window.partitionBy("Ticker")`` puts a whole ticker into one task; with one ticker
holding a third of all rows that task is the job. Instead every ordered computation here runs
per (series key, chunk):

1. ``index_rows`` numbers rows per series (``_rn``, 0-based, in series order) without a
   per-series window: rows are numbered inside fixed time blocks (bounded after dedup), and each
   block gets its row offset from a per-block count table (a few rows per series).
2. ``with_halo`` cuts the numbered series into chunks of ``chunk_rows`` rows and copies the last
   ``halo`` rows before each chunk into it (``_core`` = false for the copies), so lag/rolling
   windows and recurrences of bounded memory see their full look-back.
3. Windows run over ``partitionBy(keys, _chunk).orderBy(_rn)``; halo copies are dropped after.
4. ``prefix_scan`` gives unbounded running sums/max/products: chunk-local running value plus the
   carry of all earlier chunks from the (small) per-chunk total table.
"""

from __future__ import annotations

from typing import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark import config
from barspark.session import materialize

RN, CHUNK, CORE, HOME = "_rn", "_chunk", "_core", "_home"


def chunk_rows(df: DataFrame) -> int:
    spark = df.sparkSession
    return int(spark.conf.get(config.CHUNK_ROWS_CONF, str(config.DEFAULT_CHUNK_ROWS)))


def block_seconds(df: DataFrame) -> int:
    spark = df.sparkSession
    return int(spark.conf.get(config.BLOCK_SECONDS_CONF, str(config.DEFAULT_BLOCK_SECONDS)))


def _order_cols(order: Sequence) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def time_block(time: Column, secs: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(secs * 1_000_000))


def index_rows(df: DataFrame, keys: Sequence[str] = ("Ticker",), order: Sequence = ("Timestamp",),
               time_col: str | None = "Timestamp", block_secs: int | None = None) -> DataFrame:
    """Add ``_rn``: 0-based position of each row in its series, ordered by ``order``.

    ``time_col`` picks the time blocks (rows per block are bounded once (key, time) is unique);
    with ``time_col=None`` the first order column must be an integer position already.
    """
    keys = list(keys)
    secs = block_secs or block_seconds(df)
    if time_col is not None:
        blk = time_block(F.col(time_col), secs)
    else:
        first = _order_cols(order)[0]
        blk = F.floor(first / F.lit(65536))
    d = df.withColumn("_blk", blk)
    in_block = Window.partitionBy(*keys, "_blk").orderBy(*_order_cols(order))
    d = d.withColumn("_bn", F.row_number().over(in_block) - 1)
    counts = d.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_bc"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_blk", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_boff"))
    return (d.join(offsets, [*keys, "_blk"])
            .withColumn(RN, (F.col("_boff") + F.col("_bn")).cast("long"))
            .drop("_blk", "_bn", "_boff"))


def with_chunks(df: DataFrame, rows: int | None = None) -> DataFrame:
    rows = rows or chunk_rows(df)
    return df.withColumn(CHUNK, F.floor(F.col(RN) / F.lit(rows)).cast("long"))


def with_halo(df: DataFrame, halo: int, rows: int | None = None, ahead: int = 0) -> DataFrame:
    """Assign rows to chunks of ``rows``; the ``halo`` rows before a chunk and the ``ahead`` rows
    after it are copied into it (``_core`` false), so bounded look-back/look-ahead is complete."""
    rows = rows or chunk_rows(df)
    home = F.floor(F.col(RN) / F.lit(rows)).cast("long")
    if halo <= 0 and ahead <= 0:
        return df.withColumn(CHUNK, home).withColumn(CORE, F.lit(True))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col(RN) - F.lit(ahead)) / F.lit(rows)).cast("long"))
    last = F.floor((F.col(RN) + F.lit(halo)) / F.lit(rows)).cast("long")
    return (df.withColumn(HOME, home)
            .withColumn(CHUNK, F.explode(F.sequence(first, last)))
            .withColumn(CORE, F.col(CHUNK) == F.col(HOME))
            .drop(HOME))


def chunk_window(keys: Sequence[str] = ("Ticker",)) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(RN)


def run_ordered(df: DataFrame, build: Callable[[DataFrame, Window], DataFrame], halo: int,
                keys: Sequence[str] = ("Ticker",), order: Sequence = ("Timestamp",),
                time_col: str | None = "Timestamp", keep_index: bool = False,
                indexed: bool = False, ahead: int = 0) -> DataFrame:
    """Index, chunk with ``halo`` look-back (and ``ahead`` look-ahead) rows, apply
    ``build(df, window)``, drop the copies."""
    d = df if indexed else index_rows(df, keys, order, time_col)
    d = with_halo(d.drop(CHUNK, CORE) if indexed else d, halo, ahead=ahead)
    out = build(d, chunk_window(keys))
    out = out.filter(F.col(CORE)).drop(CORE)
    if not keep_index:
        out = out.drop(RN, CHUNK)
    return out


_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min, "prod": F.product, "runmax": F.max, "runmin": F.min}


def prefix_scan(df: DataFrame, specs: dict[str, tuple[str, Column]], keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Unbounded running aggregates over a series that carries ``_rn`` and ``_chunk`` (no halo rows).

    ``specs`` maps output name -> (op, column) with op in sum/max/min/prod; like pandas
    ``cumsum``/``cummax`` NULL inputs stay NULL and are skipped. ``runmax``/``runmin`` give the
    running extreme on every row (NULL inputs included).
    """
    keys = list(keys)
    if CHUNK not in df.columns:
        df = with_chunks(df)
    w_local = Window.partitionBy(*keys, CHUNK).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    local = df
    for name, (op, c) in specs.items():
        local = local.withColumn(f"_in_{name}", c)
    local = local.select("*", *[_LOCAL[op](F.col(f"_in_{name}")).over(w_local).alias(f"_loc_{name}")
                               for name, (op, _) in specs.items()])
    totals = local.groupBy(*keys, CHUNK).agg(*[_LOCAL[op](F.col(f"_in_{name}")).alias(f"_tot_{name}")
                                               for name, (op, _) in specs.items()])
    prior = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, CHUNK, *[_LOCAL[op](F.col(f"_tot_{name}")).over(prior).alias(f"_car_{name}")
                                          for name, (op, _) in specs.items()])
    out = local.join(carry, [*keys, CHUNK], "left")
    for name, (op, _) in specs.items():
        loc, car = F.col(f"_loc_{name}"), F.col(f"_car_{name}")
        if op == "sum":
            value = F.when(loc.isNull(), car).otherwise(loc + F.coalesce(car, F.lit(0.0)))
        elif op == "prod":
            value = F.when(loc.isNull(), car).otherwise(loc * F.coalesce(car, F.lit(1.0)))
        elif op in ("max", "runmax"):
            value = F.greatest(loc, car)
        else:
            value = F.least(loc, car)
        if op in ("sum", "prod", "max", "min"):
            # pandas cumsum/cummax keep NaN at NaN inputs and carry on after them.
            value = F.when(F.col(f"_in_{name}").isNotNull(), value)
        out = out.withColumn(name, value).drop(f"_in_{name}", f"_loc_{name}", f"_car_{name}")
    return out


def _by_range(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by range of ``key``, written, with the number of their range: both uses of it agree."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id()))


def next_by_key(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One row per ``key``: each column of ``cols`` becomes its next value that isn't NULL in later rows by ``key``.

    A task sees one range of keys; the ranges' first values (a row per shuffle partition) give the rest."""
    d = _by_range(df, key)
    heads = d.groupBy("_range").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"_h_{c}") for c in cols])
    later = Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    after = heads.select("_range", *[F.first(f"_h_{c}", ignorenulls=True).over(later).alias(f"_n_{c}") for c in cols])
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(1, Window.unboundedFollowing)
    d = d.select("*", *[F.first(c, ignorenulls=True).over(inside).alias(f"_i_{c}") for c in cols])
    return d.join(F.broadcast(after), "_range").select(
        key, *[F.coalesce(f"_i_{c}", f"_n_{c}").alias(c) for c in cols])


def number_by_key(df: DataFrame, key: str, out: str) -> DataFrame:
    """``out``: 0, 1, … in the order of the distinct ``key`` values; ranges as in ``next_by_key``."""
    d = _by_range(df, key)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return (d.withColumn(out, place).join(F.broadcast(starts), "_range")
            .withColumn(out, (F.col("_start") + F.col(out)).cast("int")).drop("_range", "_start"))


def latest_n(df: DataFrame, n: int, keys: Sequence[str] = ("Ticker",), order: Iterable = ("Timestamp",)) -> DataFrame:
    """Last ``n`` rows of every series (ties by the order columns)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() if isinstance(o, str) else o.desc() for o in order])
    # Filter on row_number over a window plans a WindowGroupLimit (per-partition top-n before the
    # shuffle), so a hot series never ships more than n rows per map task.
    return df.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= n).drop("_pos")


def head_n(df: DataFrame, n: int, keys: Sequence[str] = ("Ticker",), order: Iterable = ("Timestamp",)) -> DataFrame:
    """First ``n`` rows of every series; cut map-side as in ``latest_n``."""
    w = Window.partitionBy(*keys).orderBy(*_order_cols(list(order)))
    return df.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= n).drop("_pos")
