"""Exponential moving averages (E02) as window sums over blocks of a chunked series.

y_t = (1-a) y_{t-1} + a x_t with y_0 = x_0 (pandas ``ewm(adjust=False)``) is an affine map of y per row;
a run of rows composes to one affine map y -> P y + Q. With d = 1-a, P is a power of d, and Q is the
power times a running sum of a x_i / d^i. Such a sum only holds while d^i stays far from underflow,
so it runs inside blocks of B rows: d^B is below the tolerance for the slowest step and far above the
smallest double for the fastest one (steps too far apart get blocks of their own). A row's value is
its block's own sum plus the map of its block applied to the end of the block before.

A missing x keeps y, and the next value counts against the decayed weight of the last one:
y_t = (d^k y + a x_t) / (d^k + a) after a gap of k rows. Gaps only scale the maps, by a second
running sum of logarithms that is zero where nothing is missing.

All windows of a block length share one sort by (series, chunk, block, row). Chunks carry a halo long
enough that the start value's weight has decayed below ``EMA_TOLERANCE``; the chunk that holds the
start of its series starts exactly there.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark import config
from barspark.functions.columns import ema_alpha, ema_memory
from barspark.plans.series import CHUNK, RN

# A step is (output, source, span); source is a column name or a pair (a, b) meaning a - b, so a
# MACD signal line can be chained on EMAs computed earlier in the same pass.
Step = tuple

MAX_LOG = 500.0  # largest |ln d^B|: e^500 times any price is a finite double


def ema_halo(steps: Sequence[Step], tol: float = config.EMA_TOLERANCE) -> int:
    """Look-back rows needed so every step is exact to ``tol`` (chained steps add up)."""
    produced = {}
    for out, src, span in steps:
        deps = [src] if isinstance(src, str) else list(src)
        base = max([produced.get(d, 0) for d in deps] + [0])
        produced[out] = base + ema_memory(span, tol)
    return max(produced.values()) if produced else 0


def block_lengths(spans: Sequence[float], tol: float = config.EMA_TOLERANCE) -> list[tuple[int, list[float]]]:
    """(block length, spans that can share it), slowest first; span 1 needs no memory and goes along."""
    out: list[tuple[int, list[float]]] = []
    for span in sorted(set(spans), reverse=True):
        d = 1.0 - ema_alpha(span)
        if out and (d <= 0.0 or out[-1][0] * -math.log(d) <= MAX_LOG):
            out[-1][1].append(span)
        else:
            out.append((max(2, ema_memory(span, tol)), [span]))
    return out


def _waves(steps: Sequence[Step]) -> list[list[Step]]:
    """Steps in groups that only read columns of earlier groups."""
    level: dict[str, int] = {}
    out: list[list[Step]] = []
    for step in steps:
        name, src, _ = step
        n = max([level.get(s, -1) + 1 for s in ([src] if isinstance(src, str) else src)])
        level[name] = n
        out += [[] for _ in range(n + 1 - len(out))]
        out[n].append(step)
    return out


def with_ema(df: DataFrame, steps: Sequence[Step], keys: Sequence[str] = ("Ticker",)) -> DataFrame:
    """Add EMA columns to a chunked frame (needs ``_rn`` and ``_chunk``; halo rows included)."""
    names = [*df.columns, *[out for out, _, _ in steps]]
    made: set[str] = set()
    for wave in _waves(steps):
        for length, spans in block_lengths([span for _, _, span in wave]):
            part = [s for s in wave if s[2] in spans]
            df = _with_block_sums(df, part, length, list(keys), made)
        made |= {out for out, _, _ in wave}
    return df.select(*names)


def _with_block_sums(df: DataFrame, steps: Sequence[Step], length: int, keys: list[str], made: set[str]) -> DataFrame:
    rn, block = F.col(RN), "_sub"
    df = df.withColumn(block, F.floor(rn / F.lit(length)))
    row = Window.partitionBy(*keys, CHUNK).orderBy(block, RN)
    before, so_far = row.rowsBetween(Window.unboundedPreceding, -1), row.rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(*keys, CHUNK, block).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    position = (rn - F.col(block) * length).cast("double")

    def source(src) -> Column:
        return (F.col(src) if isinstance(src, str) else F.col(src[0]) - F.col(src[1])).cast("double")

    # The row before that holds a value. An EMA has no gaps after its first value, nor has a difference of
    # two; it begins where the later one of its sources begins.
    plain = sorted({src for _, src, _ in steps if isinstance(src, str) and src not in made})
    df = df.withColumns({f"_pv_{s}": F.last(F.when(F.col(s).isNotNull(), rn), ignorenulls=True).over(before) for s in plain})

    def begins(src) -> Column:
        if isinstance(src, str) and src not in made:
            return F.col(f"_pv_{src}").isNull()
        parts = [begins_of[s] for s in ([src] if isinstance(src, str) else src)]
        return F.greatest(*parts) if len(parts) > 1 else parts[0]

    begins_of = {c: F.col(f"_begin_{c}") for c in made}
    gap_logs, terms, ends, values = {}, {}, {}, {}
    for out, src, span in steps:
        a = ema_alpha(span)
        d = 1.0 - a
        x, first = source(src), begins(src)
        if d <= 0.0:
            values[out] = x
            continue
        if src in plain:
            decay = F.pow(F.lit(d), (rn - F.col(f"_pv_{src}")).cast("double"))
            scale = F.when(first | (rn - F.col(f"_pv_{src}") == 1), F.lit(1.0)).otherwise(F.lit(1.0) / (decay + F.lit(a)))
            gap_logs[f"_g_{out}"] = F.sum(F.when(x.isNotNull(), F.log(scale))).over(inside)
            gap = F.coalesce(F.col(f"_g_{out}"), F.lit(0.0))
        else:
            scale, gap = F.lit(1.0), F.lit(0.0)
        weight = F.when(first, F.lit(1.0)).otherwise(F.lit(a) * scale)
        terms[f"_s_{out}"] = F.sum(weight * x * F.exp(-gap) * F.pow(F.lit(d), -position)).over(inside)
        at_end = F.when(rn % length == length - 1, F.exp(gap) * F.col(f"_s_{out}"))
        ends[f"_e_{out}"] = F.last(at_end, ignorenulls=True).over(before)
        here = F.exp(gap) * F.pow(F.lit(d), position)
        values[out] = here * (F.coalesce(F.col(f"_s_{out}"), F.lit(0.0))
                              + F.coalesce(F.col(f"_e_{out}"), F.lit(0.0)) * F.lit(d ** length))
    df = df.withColumns({f"_begin_{out}": source(src).isNotNull() & begins(src) for out, src, _ in steps})
    df = df.withColumns(gap_logs) if gap_logs else df
    df = df.withColumns(terms).withColumns(ends) if terms else df
    df = df.withColumns({out: F.when(source(src).isNotNull(), values[out]) for out, src, _ in steps})
    held = [out for out, src, _ in steps if src in plain]
    if held:  # a row without a value repeats the last one
        df = df.withColumns({out: F.last(out, ignorenulls=True).over(so_far) for out in held})
    return df.drop(block, *[f"_pv_{s}" for s in plain], *gap_logs, *terms, *ends)
