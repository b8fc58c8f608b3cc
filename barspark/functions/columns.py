"""Column builders shared by all operators (JVM-side expressions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """num / den with NULL for a zero or NULL denominator (the library-wide division policy)."""
    return F.try_divide(col(num), col(den))


def pct_change(c, n: int, w: Window) -> Column:
    """x / lag(x, n) - 1 over ``w`` (NULL during warm-up or after a zero)."""
    return safe_div(col(c), F.lag(col(c), n).over(w)) - F.lit(1.0)


def roll(agg, c, n: int, w: Window) -> Column:
    """pandas ``rolling(n).agg()``: NULL until the frame holds n non-null values."""
    frame = w.rowsBetween(-(n - 1), 0)
    x = col(c)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def roll_mean(c, n, w):
    return roll(F.avg, c, n, w)


def roll_std(c, n, w):
    # stddev_samp of a single value is NULL in Spark and NaN in pandas; n >= 2 everywhere here.
    return roll(F.stddev_samp, c, n, w)


def roll_sum(c, n, w):
    return roll(F.sum, c, n, w)


def flag(cond: Column) -> Column:
    """Boolean -> INT with NULL comparisons counted as 0 (pandas ``(a > b).astype(int)``)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def nan_to_null(c) -> Column:
    x = col(c)
    return F.when(~F.isnan(x), x)


def round_half_away(c, digits: int) -> Column:
    """round(x * 10^d) / 10^d on the binary value, half away from zero.

    Spark's ``round`` rounds the shortest decimal string of a double, so a value printed as
    ...5 but stored just below it rounds up; scaling first rounds the stored value, which is what
    SQL engines that round in floating point do. Outputs are rounded this way so equal doubles
    stay equal after rounding, on any engine.
    """
    scale = float(10 ** digits)
    y = col(c) * F.lit(scale)
    # Doubles at or above 2^52 are integers already; Spark's decimal-based round is not an
    # identity on them, so they pass through unchanged (as a floating-point round does).
    return F.when(F.abs(y) >= F.lit(4503599627370496.0), y).otherwise(F.round(y, 0)) / F.lit(scale)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT column (outputs compared against the SQL oracle)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(round_half_away(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def ntz(c) -> Column:
    """Instant (TIMESTAMP, UTC session) -> wall-clock TIMESTAMP_NTZ for outputs."""
    return col(c).cast("timestamp_ntz")


def output(df: DataFrame, digits: int = 6) -> DataFrame:
    """Final projection for query outputs: NTZ timestamps, rounded doubles."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(ntz(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return round_doubles(df.select(*cols), digits)


def ema_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def ema_memory(span: float, tol: float) -> int:
    """Rows after which the start value's weight (1-alpha)^k falls below ``tol``."""
    d = 1.0 - ema_alpha(span)
    if d <= 0.0:
        return 0
    return int(math.ceil(math.log(tol) / math.log(d)))


def round_sig(c, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (for compounded quantities that span 1e-3..1e45,
    where a fixed number of decimals is meaningless). Same operation order as the SQL oracle."""
    x = col(c)
    # 10^e parsed from "1e<e>": correctly rounded on every engine (pow() differs by an ulp).
    scale = F.concat(F.lit("1e"), F.floor(F.log10(F.abs(x))).cast("bigint").cast("string")).cast("double")
    return F.when(x == 0, F.lit(0.0)).otherwise(round_half_away(x / scale, digits - 1) * scale)
