"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens every match must contain. The index keeps
each rule under the one of its tokens that the urls hold least often; a url's tokens fetch
candidate rules by an equi-join, and only those run their expression. Rules without a usable token
are kept under the empty token, which every url has. Urls are judged once per distinct url.

Defined cases: null, empty or scheme-less urls have empty host and path, fit no rule and get the
default verdict (a filter list blocks only what it names); of several fitting rules the longest
wins, then the smallest rule text; repeated rows are all returned; empty tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import lower_ascii, packed, unpacked

# The rule list of op9 as (verdict, host/path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
DEFAULT_VERDICT = "allow"
RULE_SCHEMA = "rule string, verdict string, pattern string, tokens array<string>, length int"


def domain_rule(verdict: str, rule: str) -> tuple:
    """A rule ``host/path``: fits the host, its subdomains and paths that start with the path."""
    host, slash, path = rule.partition("/")
    path = slash + path
    pattern = r"^(?:[^/]*\.)?" + _quoted(host.lower()) + _quoted(path)
    # A literal token counts only if it ends at a delimiter inside the rule: the url may go on.
    closed = host.lower() + (path[: path.rindex("/") + 1] if path else "")
    tokens = sorted(set(re.findall("[0-9a-z]+", closed.lower()))) if path else []
    return rule, verdict, pattern, tokens, len(rule)


def _quoted(s: str) -> str:
    return re.sub(r"([^0-9A-Za-z/])", r"\\\1", s)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([domain_rule(v, r) for v, r in rules], RULE_SCHEMA)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def url_tokens(target: Column) -> Column:
    """Distinct tokens of a url, the empty token included."""
    found = F.split(lower_ascii(target), "[^0-9a-z]+")
    return F.array_distinct(F.concat(found, F.array(F.lit(""))))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with ``token``: the literal token that the fewest of ``urls`` (target) hold."""
    literal = rules.select("rule", F.explode("tokens").alias("token"))
    held = (urls.select(F.explode(url_tokens(F.col("target"))).alias("token"))
            .join(literal.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = (literal.join(held, "token", "left").groupBy("rule")
              .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")))
    return rules.join(rarest, "rule", "left").withColumn("token", F.coalesce("token", F.lit("")))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Input rows with host, path, rule (null if none fits) and verdict."""
    host, path = host_and_path(F.col("row").getField(url))
    rows = packed(df).select("row", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    rows = rows.withColumn("target", F.concat("host", "path"))
    urls = rows.select("target").where("target <> ''").distinct()
    index = rule_index(urls, rules)
    fits = (urls.select("target", F.explode(url_tokens(F.col("target"))).alias("token"))
            .join(index, "token").where(F.rlike("target", "pattern"))
            .groupBy("target").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.col("length"), "rule")).alias("best")))
    judged = rows.join(fits, "target", "left").withColumns({
        "rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))})
    return unpacked(judged, "host", "path", "rule", "verdict")
