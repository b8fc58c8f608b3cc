"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens.

Base kinds (assign, access, hex) are their regular expressions, leftmost and non-overlapping per
kind. The method adds kind ``random``: every token of 20 or more base64 characters is tested under
the encoding inferred from its characters (hex, base32, base64):

* chi-squared statistic of the alphabet's uniformity, compared with its law for word-like text
  (null hypothesis: the token is ordinary text). Its p-value falls with the token's length;
* runs above and below the alphabet's middle, and lag-1 serial correlation: a token that fails
  either test of randomness gets p = 1.

A Benjamini-Hochberg threshold is set for each stratum (encoding, power of two of the length) over
all tokens of the table, from a histogram of p-values: at most ``FDR`` of the reported tokens of a
stratum are expected to be ordinary text. Only DataFrame functions run; positions come from the
lengths of matches and of the pieces between them, summed in blocks, so that long texts with many
matches stay near-linear.

Defined cases: null or empty text has no spans; pure numbers are no secrets; repeated rows are all
returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import cut

# The expressions of the contract, and the alphabets of the encodings.
ASSIGN_HEAD = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
# Word-like text: chance that two symbols agree, and that three do (letters of running text).
PAIR, TRIPLE = {"hex": 0.12, "base32": 0.066, "base64": 0.066}, {"hex": 0.02, "base32": 0.0062, "base64": 0.0062}
GATE = 3.29        # two-sided 0.001 limit of the runs and serial tests
FDR = 0.01
BINS_PER_DECADE, DECADES = 100, 16
BLOCK = 512        # matches whose positions are summed one by one

SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array: inside blocks of BLOCK values, then over the blocks' totals."""
    def sums(a: Column) -> Column:  # appends to an array, so it is only used on short ones
        return F.slice(F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(
            acc, F.array(F.element_at(acc, -1) + x))), F.lit(1), F.size(a) + 1)

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return F.transform(starts, lambda b: sums(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

    def joined(parts: Column) -> Column:
        totals = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.slice(totals, F.lit(1), F.size(parts)), lambda p, before: F.transform(
            F.slice(p, F.lit(2), F.size(p)), lambda x: x + before)))

    return F.when(F.size(values) > 0, let(blocks(values), joined)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<token,start,end>> of all matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    return let(F.struct(found.alias("f"), pieces.alias("p")), lambda x: let(
        running_sums(F.zip_with(x["f"], F.slice(x["p"], F.lit(1), F.size(x["f"])), lambda m, p: F.length(m) + F.length(p))),
        lambda ends: F.zip_with(x["f"], ends, lambda m, e: F.struct(
            m.alias("token"), (e - F.length(m)).alias("start"), e.alias("end")))))


def spans(text: Column, kind: str, pattern: str, quick: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of one kind; the positions are worked out only for texts that hold ``quick``."""
    found = matches(text, pattern)
    if keep is not None:
        found = F.filter(found, keep)
    rank = F.lit(KINDS.index(kind))
    out = F.transform(found, lambda m: F.struct(m["start"].alias("start"), rank.alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(F.rlike(text, F.lit(quick)), out).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    long_enough = lambda m: F.length(F.regexp_extract(m["token"], ASSIGN, 2)) >= ASSIGN_LEAST
    quick = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]{%d}" % ASSIGN_LEAST
    return F.array_sort(F.concat(spans(text, "assign", ASSIGN, quick, long_enough),
                                 spans(text, "access", ACCESS, ACCESS), spans(text, "hex", HEX, HEX)))


def encoding(token: Column) -> Column:
    """Encoding a token (without padding) can be in; null for plain numbers."""
    return (F.when(F.rlike(token, F.lit("^[0-9]*$")), F.lit(None))
            .when(F.rlike(token, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), "hex")
            .when(F.rlike(token, F.lit("^[A-Z2-7]+$")), "base32").otherwise("base64"))


def normal_tail(z: Column) -> Column:
    """P(Z <= z) of the standard normal law, by a logistic form (error below 2e-4)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def text_p_value(token: Column, name: str) -> Column:
    """p-value of "ordinary text" for a token under an encoding; 1 where a randomness gate fails."""
    alphabet, k = ALPHABETS[name], len(ALPHABETS[name])
    n = F.length(token).cast("double")
    squares = F.aggregate(F.array(*[F.lit(a) for a in alphabet]), F.lit(0.0), lambda acc, a: acc + F.pow(
        F.length(token) - F.length(F.replace(token, a, F.lit(""))), F.lit(2.0)))
    chi = F.lit(float(k)) * squares / n - n
    mean = k * (n - 1) * PAIR[name] + k - n
    var = 2.0 * (k - 1) + 4.0 * k * k * n * (TRIPLE[name] - PAIR[name] ** 2)
    p = normal_tail((chi - mean) / F.sqrt(var))
    values = F.transform(F.split(token, "", -1), lambda c: F.position(c, F.lit(alphabet)) - (k + 1) / 2.0)

    def gates(v: Column) -> Column:
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(
            (a * b).alias("prod"), F.when((a > 0) != (b > 0), 1.0).otherwise(0.0).alias("turn")))
        total = F.aggregate(pairs, F.struct(F.lit(0.0).alias("prod"), F.lit(0.0).alias("turn")), lambda s, x: F.struct(
            (s["prod"] + x["prod"]).alias("prod"), (s["turn"] + x["turn"]).alias("turn")))
        energy = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
        high = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(x > 0, 1.0).otherwise(0.0))
        expected = 2.0 * high * (n - high) / n + 1
        spread = F.sqrt((expected - 1) * (expected - 2) / (n - 1))
        serial = F.abs(total["prod"] / energy) * F.sqrt(n)
        return (spread > 0) & (F.abs(total["turn"] + 1 - expected) <= GATE * spread) & (serial <= GATE)

    passed = let(values, gates)
    return F.when(passed, p).otherwise(1.0)


def candidates(text: Column) -> Column:
    """array<struct<start,end,stratum,bin>> of the tokens to judge; bin: how small the p-value is."""
    def plain(m: Column) -> Column:
        return F.rtrim(F.translate(m["token"], "-_", "+/"), F.lit("="))

    def tested(m: Column) -> Column:
        return let(plain(m), lambda t: let(encoding(t), lambda e: let(
            F.when(e == "hex", text_p_value(F.lower(t), "hex")).when(e == "base32", text_p_value(t, "base32"))
            .when(e == "base64", text_p_value(t, "base64")),
            lambda p: F.struct(
                m["start"].alias("start"), m["end"].alias("end"),
                F.concat(e, F.lit(":"), F.floor(F.log2(F.length(t).cast("double"))).cast("string")).alias("stratum"),
                F.floor(F.least(F.lit(float(DECADES)), -F.log10(F.greatest(p, F.lit(1e-300)))) * BINS_PER_DECADE).cast("int").alias("bin")))))

    found = F.filter(F.transform(matches(text, TOKEN), tested), lambda t: t["stratum"].isNotNull())
    return F.when(F.rlike(text, F.lit(TOKEN)), found).otherwise(
        F.array().cast("array<struct<start:int,end:int,stratum:string,bin:int>>"))


def thresholds(tested: DataFrame) -> dict[str, int]:
    """Least bin reported in each stratum. Strata are few: 3 encodings x powers of two of a length."""
    hist = (tested.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").agg(F.count(F.lit(1)).alias("n")))
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())  # at most 1601 bins a stratum
    every = Window.partitionBy("stratum")
    passing = (hist.select("stratum", "bin", F.sum("n").over(down).alias("reported"), F.sum("n").over(every).alias("m"))
               .where(F.col("m") * F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= FDR * F.col("reported")))
    return {r[0]: r[1] for r in passing.groupBy("stratum").agg(F.min("bin")).collect()}


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row, with ``base`` and ``spans``: arrays of (start, rank, end, kind)."""
    body = F.coalesce(F.col(text), F.lit(""))
    tested = cut(df.select(*keep, base_spans(body).alias("base"), candidates(body).alias("candidates")), "secrets")
    least = thresholds(tested)
    if not least:
        return tested.select(*keep, "base", F.col("base").alias("spans"))
    limit = F.create_map(*[F.lit(x) for kv in sorted(least.items()) for x in kv])
    random = F.transform(F.filter("candidates", lambda c: c["bin"] >= F.element_at(limit, c["stratum"])), lambda c: F.struct(
        c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), c["end"].alias("end"), F.lit("random").alias("kind")))
    return tested.select(*keep, "base", F.array_sort(F.concat("base", random)).alias("spans"))
