"""Dataset preparation.

Splits are row-number ranges per ticker; the scaler is one global aggregate; sequences are
trailing ``collect_list`` windows over the chunked series (halo L-1), so a window never needs a
whole ticker in one task. Small dimension tables (24-row scaler, 5-row fold table) are broadcast.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark import config as C
from barspark.plans import series
from barspark.plans.series import RN

TARGETS = [f"target_t{h}" for h in range(1, C.HORIZON + 1)]


def with_counts(df: DataFrame, keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Attach ``_rn`` and the series length ``_n`` (from a one-row-per-ticker count table)."""
    d = df if RN in df.columns else series.index_rows(df, keys)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return d.join(n, list(keys))


def split_train_val(df: DataFrame, v: float = C.VALIDATION_SPLIT, L: int = C.SEQUENCE_LENGTH) -> DataFrame:
    """``is_train`` = rn < floor(n(1-v)); ``is_val`` = rn >= max(L, cutoff - L) (rows may be in both)."""
    d = with_counts(df)
    cutoff = F.floor(F.col("_n") * F.lit(1.0 - v)).cast("long")
    return d.withColumns({"_cutoff": cutoff, "is_train": F.col(RN) < cutoff,
                          "is_val": F.col(RN) >= F.greatest(F.lit(L).cast("long"), cutoff - L)})


def fit_scaler(df: DataFrame, cols: Sequence[str] = tuple(C.PACKAGE_FEATURES)) -> DataFrame:
    """Mean and population std over all tickers' rows together; zero std -> scale 1."""
    agg = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)])
    long = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{i}").alias("mean"),
                                                   F.col(f"s_{i}").alias("std")) for i, c in enumerate(cols)])).alias("s"))
    return long.select("s.feature", "s.mean", F.when(F.col("s.std") == 0, 1.0).otherwise(F.col("s.std")).alias("scale"))


def scale(df: DataFrame, params: DataFrame, cols: Sequence[str] = tuple(C.PACKAGE_FEATURES)) -> DataFrame:
    """(x - mean) / scale. The scaler has one row per feature (fixed, tiny): pivoted to one
    row and broadcast to every task."""
    wide = params.agg(*[F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"_m{i}") for i, c in enumerate(cols)],
                      *[F.max(F.when(F.col("feature") == c, F.col("scale"))).alias(f"_s{i}") for i, c in enumerate(cols)])
    d = df.crossJoin(F.broadcast(wide))
    d = d.withColumns({c: (F.col(c).cast("double") - F.col(f"_m{i}")) / F.col(f"_s{i}") for i, c in enumerate(cols)})
    return d.drop(*[f"_m{i}" for i in range(len(cols))], *[f"_s{i}" for i in range(len(cols))])


def with_stock_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Ticker -> dense id (one row per ticker; broadcast when small, AQE decides)."""
    return df.join(ids, "Ticker")


def sequences(df: DataFrame, L: int, cols: Sequence[str], targets: Sequence[str], ranges: dict) -> DataFrame:
    """Every window of L consecutive rows of a split; target = the last row's targets.

    ``ranges`` maps split name -> (first_rn_col, last_rn_col) columns on ``df`` bounding the split.
    A window ending at row e belongs to a split when first <= e - L + 1 and e <= last.
    """
    row = F.array(*[F.col(c).cast("float") for c in cols])

    def build(d, w):
        return d.withColumn("X", F.collect_list(row).over(w.rowsBetween(-(L - 1), 0)))

    d = series.run_ordered(df, build, halo=L - 1, keep_index=True)
    labels = F.array(*[F.when((F.col(RN) - (L - 1) >= F.col(lo)) & (F.col(RN) <= F.col(hi)), F.lit(name))
                       for name, (lo, hi) in ranges.items()])
    d = d.withColumn("split", F.explode(F.array_compact(labels)))
    return d.withColumn("y", F.array(*[F.col(t).cast("float") for t in targets]))


def sequence_dataset(features: DataFrame, L: int = C.SEQUENCE_LENGTH, v: float = C.VALIDATION_SPLIT,
                     cols: Sequence[str] = tuple(C.PACKAGE_FEATURES)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split -> fit scaler on train rows -> scale all rows -> train/val windows.

    Returns (windows, scaler, stock_ids). Windows carry Ticker, stock_id, split, Timestamp (of the
    window's last row), X float[L][F] and y float[h].
    """
    split = split_train_val(features, v, L)
    scaler = fit_scaler(split.filter("is_train"), cols)
    scaled = scale(split, scaler, cols)
    scaled = scaled.withColumns({"_tr_lo": F.lit(0).cast("long"), "_tr_hi": F.col("_cutoff") - 1,
                                 "_va_lo": F.greatest(F.lit(L).cast("long"), F.col("_cutoff") - L),
                                 "_va_hi": F.col("_n") - 1})
    seq = sequences(scaled.drop("is_train", "is_val"), L, cols, TARGETS,
                    {"train": ("_tr_lo", "_tr_hi"), "val": ("_va_lo", "_va_hi")})
    ids = series.number_by_key(features.select("Ticker").distinct(), "Ticker", "stock_id")
    out = with_stock_id(seq, ids).select("Ticker", "stock_id", "split", "Timestamp", "X", "y")
    return out, scaler, ids


def latest_sequence(features: DataFrame, scaler: DataFrame, L: int = C.SEQUENCE_LENGTH,
                    cols: Sequence[str] = tuple(C.PACKAGE_FEATURES)) -> DataFrame:
    """The last L scaled feature rows of every ticker as one float[L][F] (batch over tickers)."""
    last = series.latest_n(features, L)
    scaled = scale(last, scaler, cols)
    row = F.struct(F.col("Timestamp").alias("ts"), F.array(*[F.col(c).cast("float") for c in cols]).alias("x"))
    return scaled.groupBy("Ticker").agg(F.sort_array(F.collect_list(row)).alias("_rows"), F.count(F.lit(1)).alias("n_rows"),
                                        F.max("Timestamp").alias("as_of")).select(
        "Ticker", "as_of", "n_rows", F.transform("_rows", lambda r: r["x"]).alias("X"))


def split_3way(df: DataFrame, train: float = 0.70, val: float = 0.85) -> DataFrame:
    """Chronological 70/15/15 split label per ticker."""
    d = with_counts(df)
    te, ve = F.floor(F.col("_n") * train), F.floor(F.col("_n") * val)
    return d.withColumn("split", F.when(F.col(RN) < te, "train").when(F.col(RN) < ve, "val").otherwise("test"))


def horizon_sequences(df: DataFrame, L: int, h: int, cols: Sequence[str], target: str) -> DataFrame:
    """X = rows i..i+L-1, y = ``target`` at row i+L+h-1 (explicit target column, T12)."""
    row = F.array(*[F.col(c).cast("float") for c in cols])

    def build(d, w):
        return d.withColumns({"X": F.collect_list(row).over(w.rowsBetween(-(L - 1), 0)),
                              "y": F.lead(F.col(target), h).over(w).cast("float")})

    d = series.run_ordered(df, build, halo=L - 1, ahead=h, keep_index=True)
    return d.filter((F.col(RN) >= L - 1) & F.col("y").isNotNull()).select("Ticker", "Timestamp", "X", "y")


def walk_forward_folds(df: DataFrame, k: int = 5, train: float = 0.70, val: float = 0.85) -> DataFrame:
    """Expanding folds; fold i trains on rn < te + i*step and tests the next ``step`` rows.

    Each row is expanded to the folds it belongs to arithmetically (no join, at most k+1 copies).
    """
    d = with_counts(df)
    te = F.floor(F.col("_n") * train).cast("long")
    step = (F.floor(F.col("_n") * val).cast("long") - te) / F.lit(1)
    step = F.floor(step / k).cast("long")
    d = d.withColumns({"_te": te, "_step": step})
    rel = F.col(RN) - F.col("_te")
    first_train = F.when(rel < 0, F.lit(0)).otherwise(F.floor(rel / F.col("_step")) + 1).cast("int")
    test_fold = F.when((rel >= 0) & (F.col("_step") > 0), F.floor(rel / F.col("_step"))).cast("int")
    roles = F.concat(
        F.transform(F.sequence(F.least(first_train, F.lit(k)), F.lit(k)),
                    lambda i: F.struct(i.alias("fold"), F.lit("train").alias("role"))),
        F.when(test_fold < k, F.array(F.struct(test_fold.alias("fold"), F.lit("test").alias("role"))))
        .otherwise(F.array().cast("array<struct<fold:int,role:string>>")))
    d = d.filter(F.col("_step") > 0).withColumn("_fr", F.explode(roles)).filter(F.col("_fr.fold") < k)
    return d.withColumns({"fold": F.col("_fr.fold"), "role": F.col("_fr.role")}).drop("_fr", "_te", "_step")


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature matrix column (array<double>), the input shape Spark ML regressors take via
    ``VectorAssembler``; arrays keep the column order explicit."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))
