"""Mixing, sharding and URL rules against plain Python."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from barspark.llm import mixing, queries, shuffle_shards, url_rules
from tests.llm.util import documents_dir

RNG = random.Random(1)


def text(n):
    return " ".join(RNG.choice(["a", "bb", "ccc\t", "é"]) for _ in range(n))


ROWS = ([Row(doc_id=i, text=text(RNG.randint(0, 30)), source=f"s{i % 3}", size="clash", row="x") for i in range(600)]
        + [Row(doc_id=1000 + i, text=text(20), source="hot", size="clash", row="x") for i in range(600)]
        + [Row(doc_id=2000, text=None, source=None, size=None, row=None), Row(doc_id=None, text="", source=None, size="", row=""),
           Row(doc_id=2001, text="w " * 30000, source="s1", size="", row=""), Row(doc_id=2002, text="x y", source=None, size="", row="")]
        + [Row(doc_id=7, text="same words here", source="s0", size="clash", row="x")] * 3)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return documents_dir(spark, tmp_path_factory, ROWS)


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def expected_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mix(spark, docs):
    got = queries.op1_mixing(spark, docs).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for r in ROWS:
        sizes[r.source] = sizes.get(r.source, 0) + n_words(r.text)
    want = expected_targets(sizes)
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
    for s, t in taken.items():
        assert abs(t - want[s]) <= 3 * largest[s] / 2 + 1, (s, t, want[s])
    again = {(r.doc_id, r.taken, r["size"]) for r in queries.op1_mixing(spark, docs).collect()}
    assert again == {(r.doc_id, r.taken, r["size"]) for r in got}


def test_mixed_rows_keep_columns(spark, docs):
    df = spark.read.parquet(f"{docs}/documents.parquet")
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    want = {(r.doc_id, r.copies) for r in mixing.mix(df).where("doc_id >= 1000").collect() if r.copies}
    got = {(r.doc_id, r["count"]) for r in out.where("doc_id >= 1000").groupBy("doc_id").count().collect()}
    assert got == want


def test_external_shuffle(spark, docs):
    got = queries.op8_external_shuffle(spark, docs).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in ROWS)))
    by_doc = {r.doc_id: r for r in ROWS}
    counts = [0] * 8
    for r in got:
        body = (by_doc[r.doc_id].text or "").encode() if r.doc_id != 7 else None
        if body is not None:
            assert (r["size"], r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        counts[r.shard] += 1
    assert max(counts) - min(counts) <= 1
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    again = {(r.doc_id, r.shard, r.slot) for r in queries.op8_external_shuffle(spark, docs).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_small_buckets_and_written_shards(spark, docs, tmp_path):
    df = spark.read.parquet(f"{docs}/documents.parquet")
    out = shuffle_shards.external_shuffle(df, bucket_bytes=500)
    assert out.select("shard", "slot").distinct().count() == len(ROWS)
    order = [r.doc_id for r in out.orderBy("slot", "shard").collect() if r.doc_id is not None]
    assert order != sorted(order)
    shuffle_shards.write_shards(df, str(tmp_path / "shards"), n_shards=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(ROWS) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


URLS = [None, "", "no scheme", "http://a.NET/x", "http://net/", "http://net", "https://sub.example.net/en/1?q#f", "https://example.net/english",
        "http://example.com/de/x", "http://xexample.com/de/x", "http://www.example.com/de", "http://b.org/fr/#x", "http://b.org?/fr/",
        "http://user@ex.org/fr/a", "://net/a", "http://a.net/y://z.org/fr/", "http://EXAMPLE.com/DE/", "x" * 20000 + "://q.net/z"]


def verdict(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(r), r, v) for v, r in url_rules.RULES for h, _, p in [r.partition("/")]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    best = max(fits) if fits else (0, None, "allow")
    return host, path, best[1], best[2]


def test_url_rules(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    rows = [(i, u, "clash") for i, u in enumerate(URLS + URLS[:5])]
    spark.createDataFrame(rows, "page_id long, url string, host string").write.parquet(f"{path}/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op9_url_rules(spark, path).collect()}
    assert got == {i: verdict(u) for i, u, _ in rows}


def test_rules_without_tokens_and_rarest_token(spark):
    rules = url_rules.rules_table(spark).unionByName(
        spark.createDataFrame([("any-x", "block", "x+y$", [], 4)], url_rules.RULE_SCHEMA))
    df = spark.createDataFrame([("http://q.io/xxy",), ("http://q.io/z",)], "url string")
    assert {r.url: r.rule for r in url_rules.judge(df, rules).collect()} == {"http://q.io/xxy": "any-x", "http://q.io/z": None}
    urls = spark.createDataFrame([("example.net/a",), ("example.net/en/b",), ("other.net/c",)], "target string")
    index = {r.rule: r.token for r in url_rules.rule_index(urls, rules).collect()}
    assert index["example.net/en/"] == "en" and index["any-x"] == "" and index["org/fr/"] in ("fr", "org")


def test_empty(spark, tmp_path_factory):
    path = documents_dir(spark, tmp_path_factory, [])
    assert queries.op1_mixing(spark, path).count() == 0
    assert queries.op8_external_shuffle(spark, path).count() == 0
    assert mixing.mix(spark.read.parquet(f"{path}/documents.parquet").withColumn("m", F.create_map())).count() == 0


def test_repeats_across_the_end_of_the_budget(spark):
    rows = [(i, " ".join(["w"] * 10), "a") for i in range(800)] + [(5000, " ".join(["r"] * 10), "a")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    split = 0
    for seed in range(6):
        got = mixing.mix(df, seed=seed).select("doc_id", "copies", "taken", "target").collect()
        assert len(got) == len(rows)
        assert abs(sum(r.taken for r in got) - got[0].target) <= 5
        split += len({r.copies for r in got if r.doc_id == 5000}) > 1
    assert split  # some seed's budget ends among the repeats


def test_shuffle_of_maps(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 3 as string) text", "map('k', id % 7) m", "named_struct('x', map(1, 2)) n")
    got = shuffle_shards.external_shuffle(df, bucket_bytes=200)
    once = {(r.id, tuple(r.m.items()), r.shard, r.slot) for r in got.collect()}
    assert len(once) == 500 and all(m == (("k", i % 7),) for i, m, _, _ in once)
    assert len({(k, s) for _, _, k, s in once}) == 500
