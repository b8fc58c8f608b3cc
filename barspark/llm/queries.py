"""The registered ``opN_`` queries: thin digests of the operators' results, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import (ann_graph, decontaminate, html_wrappers, mixing, ngram_join, pii, run_index, secrets, shuffle_shards,
                          token_alignment, toxicity, url_rules, whitening)
from barspark.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_wrappers.extract(pages).select("page_id", "url", "text", "n_chars")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
                        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
                        pii.span_text(F.col("spans")).alias("spans"))


def op4_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_graph.nearest(vectors, F.col("vec_id") % ann_graph.QUERY_EVERY == 0)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = pii.of_kinds(F.col("pii"), pii.BASE_KINDS)
    return found.select("doc_id", *[pii.count_of(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
                        F.sha2(pii.span_text(base), 256).alias("base_sha256"),
                        pii.span_text(F.col("pii")).alias("spans"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join(docs).select("doc_id", "n_shingles", "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", toxicity.is_held_out().alias("held_out"), "score",
                                              toxicity.is_toxic().cast("int").alias("predicted"))


def op8_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return shuffle_shards.external_shuffle(docs).select(
        "doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return (decontaminate.find_leaks(docs, items).select("doc_id", F.explode("leaks").alias("leak"))
            .select("doc_id", "leak.item_id", "leak.score", "leak.n_words", "leak.start_word", "leak.end_word"))


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return run_index.remove_repeats(docs).select(
        "doc_id", (length + F.octet_length("kept")).alias("n_bytes"), length.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    explained = [float(e / model.trace) for e in model.eigenvalues]
    per_component = F.posexplode(F.arrays_zip(F.col("whitened"), F.array(*[F.lit(e) for e in explained]).alias("explained")))
    return (whitening.transform(vectors, model).select("vec_id", "deviation", per_component.alias("component", "c"))
            .select("vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"),
                    F.lit(model.identity_error).alias("identity_error")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align_corpus(docs)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_html_wrappers, op3_secret_scan, op4_graph_neighbours, op5_pii, op6_ngram_join, op7_toxicity, op8_external_shuffle, op9_url_rules,
                                     op10_decontamination, op11_run_index, op12_whitening, op13_token_alignment)}

OP9_SQL = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(rule, verdict, rhost, rpath) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
         ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
keyed AS (SELECT *, row_number() OVER () AS k FROM p),
best AS (
  SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM keyed JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY k)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM keyed LEFT JOIN best USING (k)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3])) END AS sh
  FROM w),
t AS (SELECT r, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.r AS x, b.r AS y FROM t a JOIN t b ON a.g = b.g AND a.r < b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r, r AS z FROM s UNION SELECT reach.r, e.y FROM reach JOIN e ON reach.z = e.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach USING (r) JOIN s o ON o.r = reach.z GROUP BY s.r, s.doc_id, s.sh
"""

ORACLE_SQL = {"op6_ngram_join": OP6_SQL, "op9_url_rules": OP9_SQL}
