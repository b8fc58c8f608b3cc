"""Associative summaries of a series: sums, moments and the compounded curve with its drawdown.

A chunk of a series is folded into one row that can be composed with the rows of the chunks before
and after it, so a backtest reads its rows once and no series passes through one task.

The curve is the running product of ``1 + ret``. Between two factors that are not positive its sign
does not change; such a stretch is described by its least and largest size and by the worst ratio of a
size to the largest size before it. Given the product ``c`` of all earlier chunks and the peak of the
curve so far, that is enough for the worst drawdown inside the stretch:

* on the positive side ``x / max(peak, own peak)`` is the lesser of ``x / peak`` and ``x / own peak``;
* a negative value never moves a positive peak;
* a curve that has had no positive peak has no drawdown below 0, which its first value sets.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.columns import safe_div
from barspark.plans import series
from barspark.plans.series import CHUNK, RN


def _moments(values: Column) -> Column:
    return F.struct(F.count(values).cast("double").alias("n"), F.coalesce(F.avg(values), F.lit(0.0)).alias("mean"),
                    F.coalesce(F.var_pop(values) * F.count(values), F.lit(0.0)).alias("m2"))


def _joined_moments(parts: Column) -> Column:
    """Count, mean and sum of squared deviations of the union of ``parts``."""
    def step(a, b):
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        share = F.coalesce(safe_div(b["n"], n), F.lit(0.0))
        return F.struct(n.alias("n"), (a["mean"] + d * share).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * share).alias("m2"))

    return F.aggregate(parts, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), step)


def _top(stretches: Column, sign: int) -> Column:
    """Largest value of the curve in a chunk that starts at 1 (``sign`` 1) or at -1."""
    return F.array_max(F.transform(stretches, lambda s: F.when(s["sign"] * sign > 0, s["most"]).when(s["sign"] * sign < 0, -s["least"])
                                   .when(s["sign"] == 0, F.lit(0.0))))


def _worst(stretches: Column, c: Column, peak: Column) -> Column:
    """Least ratio of the curve to its positive peak in a chunk after ``c`` and ``peak``; NULL without such a peak."""
    def step(a, s):
        sign, hi, lo = s["sign"] * F.signum(c), F.abs(c) * s["most"], F.abs(c) * s["least"]
        seen = F.when(a["peak"] > 0, a["peak"])
        ratio = F.when(sign > 0, F.least(s["fall"], safe_div(lo, seen))).when(sign < 0, safe_div(-hi, seen)).when(sign == 0, F.when(seen > 0, F.lit(0.0)))
        return F.struct(F.greatest(a["peak"], F.when(sign > 0, hi).when(sign < 0, -lo).when(sign == 0, F.lit(0.0))).alias("peak"),
                        F.least(a["ratio"], ratio).alias("ratio"))

    start = F.struct(peak.cast("double").alias("peak"), F.lit(None).cast("double").alias("ratio"))
    return F.aggregate(stretches, start, step)["ratio"]


def chunk_summaries(d: DataFrame, ret: Column, sums: dict[str, Column], moments: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per (keys, chunk): ``sums``, ``moments`` (structs) and ``_stretches`` of the curve from 1."""
    keys = list(keys)
    so_far = series.chunk_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    factor = F.lit(1.0) + ret
    d = d.withColumn("_factor", factor)
    d = d.withColumns({"_local": F.product("_factor").over(so_far),
                       "_stretch": F.coalesce(F.sum((F.col("_factor") <= 0).cast("int")).over(so_far), F.lit(0))})
    d = d.withColumn("_size", F.abs("_local"))
    own = Window.partitionBy(*keys, CHUNK, "_stretch").orderBy(RN).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_fall", safe_div(F.col("_size"), F.max("_size").over(own)))
    parts = d.groupBy(*keys, CHUNK, "_stretch").agg(
        *[F.sum(c).alias(name) for name, c in sums.items()], *[_moments(c).alias(name) for name, c in moments.items()],
        F.max(F.signum("_local")).alias("sign"), F.max("_size").alias("most"), F.min("_size").alias("least"),
        F.min("_fall").alias("fall"), F.max_by("_local", RN).alias("end"))
    return parts.groupBy(*keys, CHUNK).agg(
        *[F.sum(name).alias(name) for name in sums], *[_joined_moments(F.collect_list(name)).alias(name) for name in moments],
        F.sort_array(F.collect_list(F.struct("_stretch", "sign", "most", "least", "fall", "end"))).alias("_stretches"))


def series_summaries(d: DataFrame, ret: Column, sums: dict[str, Column], moments: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per series of ``d`` (with ``_rn`` and ``_chunk``, no halo rows): ``sums``; ``moments`` as structs of
    n, mean and m2 (sum of squared deviations); ``curve_end``, the last value of the running product of
    ``1 + ret`` (NULL returns are passed over); ``drawdown``, its worst fall below the peak so far (0 or less).
    Both are NULL without a return; a curve that is 0 from the start has no drawdown."""
    keys = list(keys)
    c = chunk_summaries(d, ret, sums, moments, keys)
    prior = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_end", F.element_at("_stretches", -1)["end"])
    c = c.withColumn("_c", F.coalesce(F.product("_end").over(prior), F.lit(1.0)))
    at = F.col("_c")
    c = c.withColumn("_peak", F.when(at > 0, at * _top(F.col("_stretches"), 1)).when(at < 0, -at * _top(F.col("_stretches"), -1))
                     .otherwise(_top(F.col("_stretches"), 1) * 0.0))
    c = c.withColumn("_before", F.max("_peak").over(prior))
    c = c.withColumns({"_ratio": _worst(F.col("_stretches"), at, F.col("_before")), "_value": at * F.col("_end"),
                       "_alive": F.abs(at) * F.array_max(F.transform("_stretches", lambda s: s["most"])) > 0})
    fall = F.least(F.lit(0.0), F.min("_ratio") - 1)
    return c.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in sums], *[_joined_moments(F.collect_list(name)).alias(name) for name in moments],
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(CHUNK))).alias("curve_end"),
        F.when(F.max("_alive"), fall).alias("drawdown"))
