"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed pseudo-random hash. A source that should give r of its S words gives the rows
whose hash lies below a threshold. The threshold comes from nested histograms: words summed by
(source, leading hash digit); the digit in which the budget is reached is the boundary bucket; only
its rows are summed again by the next digit, until one row is left in it. Rows are then filtered
by comparing hashes: nothing is sorted, and a source of any size is one histogram.

Defined cases: null text has size 0; null source is a source of its own (last in order); a source
without words has target 0; repeats of a (key, text) share their hash, and where the budget ends among
them it is met by their number (which of them is arbitrary); a text of any length is one row of its size;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import cut, drop, n_words, packed, running_total, unpacked

# Production parameters of op1.
WEIGHTS = (3.0, 1.0, 2.0)   # by rank of the source in code point order, repeating
SHARE = 1.5                 # words to take, as a part of all words
CAP = 2.0                   # most times a source is taken
DIGIT_BITS, DIGITS = 12, 5  # one histogram level: 4096 buckets a source; five levels: 60 bits
SEED = 20_260_101


def _hash(key: Column, text: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, text), 64 - DIGIT_BITS * DIGITS)


def _digit(h: Column, level: int) -> Column:
    return F.shiftright(h, DIGIT_BITS * (DIGITS - 1 - level)).bitwiseAND((1 << DIGIT_BITS) - 1)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> also target: words to take from each source.

    The budget is dealt by weight; what exceeds ``cap`` times a source's size is dealt again to
    the sources below their cap, until none is above. Sources below their cap always hold one
    level times their weight, so each round needs two sums over the source table.
    """
    by_name = [F.col("source").asc_nulls_last()]
    ranked = running_total(sizes, by_name, F.lit(1), "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", w).drop("rank"), "sources")
    limit, budget_row = F.col("source_size") * F.lit(cap), ranked.agg(F.sum("source_size")).first()
    budget = share * (budget_row[0] or 0)
    level, capped = None, -1
    while budget > 0:
        full = F.lit(False) if level is None else limit <= F.lit(level) * F.col("weight")
        n, held, open_weight = ranked.agg(F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, max(0.0, budget - (held or 0.0)) / open_weight
    target = F.lit(0.0) if level is None else F.least(limit, F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", target.cast("double")).drop("weight")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, size, h) rows and (source, source_size, target) -> (…, epochs, below, tie, some).

    A row is taken ``epochs`` times, and once more if its hash is less than ``below``. Where rows of one
    hash lie across the end of the budget, ``tie`` is that hash and ``some`` of its rows are taken once more.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = cut(wanted.withColumn("epochs", whole.cast("int"))
                .withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
                .withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.col("left") > 0)
                .withColumns({"tie": F.lit(None).cast("long"), "some": F.lit(None).cast("long")}), "budgets")
    for level in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - level)
        pending = state.where("open").select(F.col("source").alias("s"), "prefix", "left")
        inside = rows.join(pending, rows["source"].eqNullSafe(pending["s"])
                           & (F.shiftright("h", shift) == F.shiftright("prefix", shift)))
        histogram = (inside.groupBy("s", "prefix", "left", _digit(F.col("h"), level).alias("digit"))
                     .agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("digit"))  # 4096 rows a source at most
        bound = (histogram.withColumn("upto", upto).where(F.col("upto") >= F.col("left"))
                 .groupBy("s").agg(F.min_by(F.struct("digit", "upto", "words", "n"), "digit").alias("b"))
                 .select("s", "b.*"))
        low = F.col("prefix") + F.shiftleft(F.col("digit").cast("long"), shift - DIGIT_BITS)
        rest = F.col("left") - (F.col("upto") - F.col("words"))
        last = (F.col("n") <= 1) | F.lit(level == DIGITS - 1)
        # A single row goes whole, if that is nearer than leaving it out; rows of one hash are counted off.
        repeats = F.lit(level == DIGITS - 1) & (F.col("n") > 1)
        end = F.when(last & ~repeats & (2 * rest >= F.col("words")), low + F.shiftleft(F.lit(1).cast("long"), shift - DIGIT_BITS)).otherwise(low)
        following = cut(state.join(bound, state["source"].eqNullSafe(bound["s"]), "left").select(
            "source", "source_size", "target", "epochs",
            F.when(F.col("digit").isNull(), F.col("left")).otherwise(rest).alias("left"),
            F.when(F.col("digit").isNull(), F.col("prefix")).otherwise(end).alias("prefix"),
            F.when(repeats, low).otherwise(F.col("tie")).alias("tie"),
            F.when(repeats, F.round(rest * F.col("n") / F.col("words"))).otherwise(F.col("some")).cast("long").alias("some"),
            (F.col("open") & F.col("digit").isNotNull() & ~F.coalesce(last, F.lit(True))).alias("open")), "budgets")
        drop(state)
        state = following
        if state.where("open").isEmpty():
            break
    return state.withColumnRenamed("prefix", "below").drop("left", "open")


def _mixed(df: DataFrame, key: str, text: str, source: str, weights, share: float, cap: float, seed: int) -> DataFrame:
    row = F.col("row")
    rows = packed(df).select("row", row.getField(source).alias("source"), n_words(row.getField(text)).alias("size"),
                             _hash(row.getField(key), row.getField(text), seed).alias("h"))
    thin = cut(rows.select("source", "size", "h"), "sized")
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(thin, targets(sizes, weights, share, cap)).withColumnRenamed("source", "s")
    drop(thin)
    planned = rows.join(plan, rows["source"].eqNullSafe(plan["s"]))
    at_end = F.coalesce(F.col("h") == F.col("tie"), F.lit(False))
    more = F.col("h") < F.col("below")
    if not plan.where("tie is not null").isEmpty():
        planned = planned.where(~at_end).withColumn("more", more).unionByName(
            counted_off(planned.where(at_end)).withColumn("more", F.col("number") < F.col("some")).drop("number"))
    else:
        planned = planned.withColumn("more", more)
    return (planned.withColumn("copies", F.col("epochs") + F.col("more").cast("int"))
            .withColumn("taken", F.col("size") * F.col("copies")))


def counted_off(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each source (0, 1, …) by their places in a scratch table: a window holds one
    file's rows of a source, which one task wrote, and the files' counts give where each starts."""
    held = cut(rows, "repeats")
    placed = held.select(*held.columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    counts = placed.groupBy("s", "file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("s").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("s").alias("_s"), F.col("file").alias("_file"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("s", "file").orderBy("place")) - 1
    return (placed.withColumn("inside", inside)
            .join(starts, F.col("s").eqNullSafe(F.col("_s")) & (F.col("file") == F.col("_file")))
            .select(*held.columns, (F.col("start") + F.col("inside")).alias("number")))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """Input rows with size, source_size, target, copies (times taken) and taken (words taken)."""
    return unpacked(_mixed(df, key, text, source, weights, share, cap, seed),
                    "size", "source_size", "target", "copies", "taken")


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
               share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: each input row as many times as it is taken, with the input's columns."""
    taken = _mixed(df, key, text, source, weights, share, cap, seed).where("copies > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))))
