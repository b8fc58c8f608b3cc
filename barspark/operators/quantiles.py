"""Exact quantiles of many groups and columns at once by distributed selection.

Groups of at most ``FEW`` values are sorted, all in one window. No task holds the values of a larger group.
A double becomes an order-preserving 64-bit integer; each round counts the integers of the intervals that
still hold a wanted rank in at most 2 ** ``BITS`` ranges, with partial aggregation, and keeps only the range
that holds the rank, narrowed to the least and greatest value found in it. After a round an interval is
``BITS`` bits narrower, so six rounds settle any data; an interval of at most ``FEW`` values is sorted.
Rounds read the input again, with the columns and rows they need; between rounds only one row per
large group and rank is kept.

A quantile between two ranks is interpolated linearly. NULL is skipped, a group without values has
NULL quantiles, NaN counts as the greatest value.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.session import materialize

BITS = 11
FEW = 10_000
MOST_BROADCAST = 200_000  # interval rows; beyond that they meet the values in a join by key

LEAST_NORMAL = 2.0 ** -1022


def order_key(x: Column) -> Column:
    """The double as a long of the same order: sign, exponent and mantissa by exact scalings with powers of two."""
    m = F.abs(x)
    guess = F.floor(F.log2(m))
    power = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(power > m, F.lit(-1)).when(m / 2 >= power, F.lit(1)).otherwise(F.lit(0))
    exponent = F.greatest(F.lit(-1022), F.least(F.lit(1023), exponent)).cast("long")
    # Two exact steps: 2^-e itself leaves the range of doubles for the greatest and least exponents.
    half = F.floor(exponent / 2)
    mantissa = m * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - exponent) * F.lit(2.0 ** 52)
    magnitude = ((exponent + 1022) * F.lit(2 ** 52) + mantissa.cast("long"))
    magnitude = F.when(m < LEAST_NORMAL, (m * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")).otherwise(magnitude)
    magnitude = F.when(m == float("inf"), F.lit(2047 * 2 ** 52)).otherwise(magnitude)
    return F.when(F.isnan(x), F.lit(2 ** 63 - 1)).when(x < 0, -magnitude).otherwise(magnitude)


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def exact_quantiles(df: DataFrame, keys: Sequence[str], values: dict[str, Column | str], probs: Sequence[float],
                    also: dict[str, Column] | None = None, few: int = FEW, bits: int = BITS) -> DataFrame:
    """Rows (keys, ``column``, ``q``, *also): ``q`` holds the quantiles at ``probs`` of each value column.

    ``also``: aggregates over ``v``, the value as double, computed in the first pass.
    """
    keys, group = list(keys), [*keys, "column"]
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(name).alias("column"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v"))
        for name, c in values.items()])).alias("_s")).select(*keys, "_s.column", "_s.v")
    whole = materialize(long.groupBy(*group).agg(
        F.count("v").alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"), *[c.alias(name) for name, c in (also or {}).items()]))
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("_n") - 1) * F.lit(float(p))), F.ceil((F.col("_n") - 1) * F.lit(float(p)))) for p in probs])))
    large = whole.filter(F.col("_n") > few)
    n_large = large.count()
    known = long.filter(F.col("v").isNotNull())
    settled = _sorted(_outside(known, large.select(*group), group, n_large), group, ranks)
    if n_large:
        settled = settled.unionByName(_selected(known, large.withColumn("_ranks", ranks), group, few, bits))
    by_rank = settled.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_values"))
    out = whole.join(by_rank, _same(whole, by_rank, group), "left").select(*[whole[c] for c in whole.columns], "_values")

    def quantile(p: float) -> Column:
        h = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(h), F.ceil(h)
        a, b = F.col("_values")[low], F.col("_values")[high]
        return F.when(low == high, a).otherwise((high - h) * a + (h - low) * b)

    return out.select(*group, F.array(*[quantile(p) for p in probs]).alias("q"), *(also or {}))


def _sorted(values: DataFrame, group: list[str], ranks: Column) -> DataFrame:
    """(group, ``_rank``, ``_v``) of groups that are small enough to be sorted."""
    w = Window.partitionBy(*group)
    d = values.select(*group, "v", (F.row_number().over(w.orderBy("v")) - 1).cast("long").alias("_rank"), F.count(F.lit(1)).over(w).alias("_n"))
    return d.filter(F.array_contains(ranks, F.col("_rank"))).select(*group, "_rank", F.col("v").alias("_v"))


def _selected(values: DataFrame, large: DataFrame, group: list[str], few: int, bits: int) -> DataFrame:
    """(group, ``_rank``, ``_v``) of large groups, by rounds."""
    keyed = values.withColumn("_k", order_key(F.col("v")))
    ends = [F.struct(order_key(F.col(c)).alias("_k"), F.col(c).alias("v")).alias(c) for c in ("_lo", "_hi")]
    # One row per wanted rank: the interval [_lo, _hi] that holds it, its size, and how many values lie below.
    state = materialize(large.select(*group, "_ranks", *ends, "_n").select(
        *group, F.explode("_ranks").alias("_rank"), "_lo", "_hi", F.col("_n").alias("_size"), F.lit(0).cast("long").alias("_below")))
    spread = (F.col("_lo._k") < F.col("_hi._k"))
    while True:
        left = state.filter(spread & (F.col("_size") > few)).agg(F.count(F.lit(1))).first()[0]
        if not left:
            break
        state = materialize(_narrowed(keyed, state, group, spread & (F.col("_size") > few), left, bits))
    settled = state.filter(~spread).select(*group, "_rank", F.col("_lo.v").alias("_v"))
    todo = state.filter(spread).groupBy(*group, "_lo", "_hi", "_below").agg(F.collect_list("_rank").alias("_ranks"))
    left = todo.count()
    if not left:
        return settled
    place = F.row_number().over(Window.partitionBy(*group, "_lo").orderBy("v")) - 1
    picked = _inside(keyed, todo, group, left, "_below", "_ranks").withColumn("_rank", F.col("_below") + place)
    return settled.unionByName(picked.filter(F.array_contains("_ranks", F.col("_rank"))).select(*group, "_rank", F.col("v").alias("_v")))


def _outside(values: DataFrame, groups: DataFrame, group: list[str], n: int) -> DataFrame:
    """The values of all other groups."""
    if not n:
        return values
    side = F.broadcast(groups) if n <= MOST_BROADCAST else groups.hint("merge")
    return values.join(side, _same(values, side, group), "left_anti")


def _inside(keyed: DataFrame, intervals: DataFrame, group: list[str], n: int, *more: str) -> DataFrame:
    """The values that lie in an interval of their group, with the interval."""
    side = F.broadcast(intervals) if n <= MOST_BROADCAST else intervals.hint("merge")
    cond = _same(keyed, side, group) & (keyed["_k"] >= side["_lo._k"]) & (keyed["_k"] <= side["_hi._k"])
    return keyed.join(side, cond).select(*[keyed[c] for c in group], keyed["_k"], keyed["v"], side["_lo"], side["_hi"], *[side[c] for c in more])


def _narrowed(keyed, state, group, active, n, bits) -> DataFrame:
    intervals = state.filter(active).select(*group, "_lo", "_hi").distinct()
    # Halves and shifted keys are subtracted: an interval may be wider than 63 bits.
    width = F.length(F.bin(F.shiftright("_hi._k", 1) - F.shiftright("_lo._k", 1))) + 1
    shift = F.greatest(F.lit(0), width - F.lit(bits))
    at = F.call_function("shiftright", F.col("_k"), shift) - F.call_function("shiftright", F.col("_lo._k"), shift)
    counted = (_inside(keyed, intervals, group, n).withColumn("_range", at)
               .groupBy(*group, "_lo", "_range").agg(F.count(F.lit(1)).alias("_c"),
                                                       *[F.struct(f("_k").alias("_k"), f("v").alias("v")).alias(c) for c, f in (("_a", F.min), ("_b", F.max))]))
    # At most 2 ** bits + 1 ranges an interval.
    so_far = F.sum("_c").over(Window.partitionBy(*group, "_lo").orderBy("_range")) - F.col("_c")
    ranges = counted.withColumn("_before", so_far)
    s = state.filter(active)
    place = s["_rank"] - s["_below"]
    moved = s.join(ranges, _same(s, ranges, [*group, "_lo"]) & (place >= ranges["_before"])
                   & (place < ranges["_before"] + ranges["_c"])).select(
        *[s[c] for c in group], s["_rank"], ranges["_a"].alias("_lo"), ranges["_b"].alias("_hi"), ranges["_c"].alias("_size"),
        (s["_below"] + ranges["_before"]).alias("_below"))
    return moved.unionByName(state.filter(~active))
