"""Toxicity, nearest neighbours and decontamination: held-out accuracy, recall, planted cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from barspark.llm import ann_graph, decontaminate, queries, toxicity
from tests.llm.util import documents_dir

RNG = random.Random(2)
VOCAB = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(500)]
BAD = ["zzqidiot", "zzqmoron", "xxvscum"]


def sentence(bad=False):
    w = [RNG.choice(VOCAB) for _ in range(RNG.randint(4, 12))]
    return " ".join(w[:2] + [RNG.choice(BAD)] * bad + w[2:])


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    items = [" ".join(RNG.choice(VOCAB) for _ in range(n)) for n in (14, 20, 35, 59)]
    rows, labels, toxic, leaks = [], [], set(), {}
    for i in range(700):
        bad = i % 6 == 0
        parts = [sentence() for _ in range(RNG.randint(2, 12))]
        if bad:
            parts.insert(RNG.randint(0, len(parts)), sentence(True))
            toxic.add(i)
        if i % 35 == 1:
            k = i % len(items)
            words = items[k].split()
            if i % 2:  # an edited copy
                words[len(words) // 2] = "changed"
                words.insert(3, "added")
            parts.insert(1, " ".join(words).upper())
            leaks[i] = k
        rows.append(Row(doc_id=i, text=". ".join(parts) + ".", score="clash"))
        labels.append((i, 1, int(bad)))
    rows += [Row(doc_id=900, text=None, score=""), Row(doc_id=901, text="", score=""), Row(doc_id=902, text="... !!", score=""),
             Row(doc_id=903, text=". ".join(sentence() for _ in range(5000)), score=""), Row(doc_id=None, text="x y", score=""), rows[0]]
    labels += [(900, 1, None), (5, None, 0), (5, 1, 0), (99999, 1, 1)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(7, None), (8, ""), (9, "two words")], "item_id long, text string")
    path = documents_dir(spark, tmp_path_factory, rows, benchmark=bench,
                         labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return path, rows, toxic, leaks


def test_toxicity_held_out(spark, corpus):
    path, rows, toxic, _ = corpus
    got = queries.op7_toxicity(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert np.mean([r.predicted == int(r.doc_id in toxic) for r in held]) >= 0.97
    assert {r.score for r in got if r.doc_id in (900, 901, 902)} == {0.0}


def test_toxicity_points_at_sentences(spark, corpus):
    path, rows, toxic, _ = corpus
    df = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(df, spark.read.parquet(f"{path}/labels.parquet"))
    found = total = 0
    for r in toxicity.score(df, model).where("score >= 0.5").collect():
        for s in r.offending:
            total += 1
            found += any(b in r.text[s.start:s.end] for b in BAD)
    assert total > 50 and found >= 0.95 * total


def test_length_alone_is_not_toxic(spark, corpus):
    path = corpus[0]
    df = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(df, spark.read.parquet(f"{path}/labels.parquet"))
    clean = df.where("doc_id = 903")  # 5,000 clean sentences
    assert toxicity.score(clean, model).first().score < 0.5 and toxicity.keep_clean(df, model).where("doc_id = 903").count() == 1
    bad = clean.withColumn("text", F.concat("text", F.lit(f". {sentence(True)}. {sentence(True)}.")))  # length hides nothing
    assert toxicity.score(bad, model).first().score >= 0.5


def test_long_documents_are_learned_from(spark):
    rng = random.Random(9)
    filler = lambda n: ". ".join(" ".join(rng.choice(VOCAB) for _ in range(8)) for _ in range(n))
    rows = [(i, f"{filler(450)}. {'zzqidiot go' if i % 3 == 0 else 'please go'}.", int(i % 3 == 0)) for i in range(60)]
    assert min(len(r[1]) for r in rows) > 20_000
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.drop("text"))
    assert model.bias is not None and model.word_weight("zzqidiot") > 1


def test_sample_is_bounded_by_total_size(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "MAX_CLASS_CHARS", 100)
    counted = toxicity.feature_counts
    monkeypatch.setattr(toxicity, "feature_counts", lambda sample: (seen.extend((r.text, r.label) for r in sample.collect()), counted(sample))[1])
    df = spark.createDataFrame([(i, "w" * (500 if i == 7 else 30), i % 2) for i in range(40)], "doc_id long, text string, toxic int")
    toxicity.train(df.drop("toxic"), df.drop("text"))
    assert sorted((len(t), c) for t, c in seen) == [(30, 0)] * 3 + [(30, 1)] * 3


def test_score_is_the_noisy_or_of_its_sentences(spark):
    model = toxicity.Model({"bad": 2.5, "good": -1.0, "ugly": 3.0, "ugly*": 0.25}, bias=-4.0, noise=0.01)
    texts = ["Bad day. Good one! ugly uglyish thing", "fine", "", None, "bad bad. bad, good", ". ".join(["bad words here"] * 40)]

    def plain(text):
        worth = {"bad": 2.5, "good": -1.0, "ugly": 3.25, "uglyish": 0.25}
        hazard = lambda x: np.log1p(np.exp(-4.0 + x)) - np.log1p(np.exp(-4.0))
        found = [set(w.strip(",!").lower() for w in s.split()) for s in (text or "").replace("!", ".").split(".") if s.strip()]
        above = [max(0.0, hazard(sum(worth.get(w, 0.0) for w in s))) for s in found]
        return 1 - np.exp(-(np.log1p(np.exp(-4.0)) + max([*above, sum(above) - 0.01 * len(found)]))) if found else 0.0

    got = {r.text: r.score for r in toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    for t in texts:
        assert got[t] == pytest.approx(plain(t), abs=1e-12)


def test_fit_follows_the_gradient():
    rng = np.random.default_rng(0)
    labels, n = np.array([1, 0, 1, 0, 0, 1]), np.array([3, 4, 2, 0, 5, 1])
    sizes = [rng.integers(1, 4, min(2, k)) for k in n]
    slots = rng.integers(0, 5, sum(int(x.sum()) for x in sizes))
    model = toxicity.fit(labels, n, slots, sizes, list("abcde"), (60, 30))

    def loss(theta, bias):
        at, total, weight = 0, 0.0, np.where(labels == 1, 30 / 3, 60 / 3)
        for d in range(6):
            hazard = np.log1p(np.exp(bias)) * (n[d] > 0)
            for k in sizes[d]:
                x = sum(theta[s] for s in slots[at:at + k])
                at += k
                hazard += max(0.0, np.log1p(np.exp(bias + x)) - np.log1p(np.exp(bias)))
            p = min(1, max(1e-9, 1 - np.exp(-hazard)))
            total += weight[d] / weight.mean() * (-np.log(p) if labels[d] else hazard) / 6
        return total

    theta = np.array([model.weights[c] for c in "abcde"])
    assert loss(theta, model.bias) < loss(np.zeros(5), toxicity.START) - 0.1


def test_labels_but_no_telling_feature(spark):
    df = spark.createDataFrame([(i, f"w{i} alone. again v{i}", i % 2) for i in range(30)] + [(40, "", 0), (41, "!", 1)], "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.drop("text"))
    assert model.weights == {} and model.noise == 0.0
    scores = {r.text: r.score for r in toxicity.score(df, model).collect()}
    assert scores[""] == 0.0 and 0 < scores["w1 alone. again v1"] < 1


def test_toxicity_without_labels(spark, corpus):
    df = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    model = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(df, model).collect()} == {0.0}


def test_leaks(spark, corpus):
    path, rows, _, leaks = corpus
    got = queries.op10_decontamination(spark, path).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(leaks.items())
    for r in got:
        words = decontaminate.words_of(next(x.text for x in rows if x.doc_id == r.doc_id))[r.start_word:r.end_word]
        assert len(words) >= 14 and 0.5 <= r.score <= 1


def test_leaks_in_blocks(spark, corpus, monkeypatch):
    path, _, _, leaks = corpus
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    got = queries.op10_decontamination(spark, path).collect()
    assert {(r.doc_id, r.item_id) for r in got} == set(leaks.items())


def test_items_without_id_and_passages_of_common_words(spark):
    common = [f"c{k}" for k in range(22)]
    item = common + [f"r{k}" for k in range(88)]  # its first 22 words are in many documents
    other = " ".join(f"n{k}" for k in range(14))
    docs = spark.createDataFrame([(i, "before " + " ".join(common) + f" after{i}") for i in range(50)] + [(99, f"x {other} y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (None, other), (None, other.upper() + " z")], "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {i: [1] for i in range(50)} | {99: [None, None]}
    assert decontaminate.keep_clean(docs, items).count() == 0


def plain_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_plain_dynamic_programme():
    for _ in range(200):
        a, b = (np.array([RNG.randint(0, 4) for _ in range(RNG.randint(1, 14))]) for _ in range(2))
        assert decontaminate.align(a, b)[0] == plain_alignment(a, b)


def test_neighbours(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    hot = rows[7][1]
    rows += [(2000 + i, hot) for i in range(700)]  # one vector that a third of the rows share
    rows += [(3000, None), (3100, []), (3200, [0.0] * 16), (3300, [float("nan")] + [1.0] * 15), (3400, [None] + [1.0] * 15),
             (3500, [float("inf")] + [1.0] * 15), (None, hot), (3600, [1.0, 2.0]), (3700, [1.0, 3.0]), rows[0]]
    path = str(tmp_path_factory.mktemp("vectors"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(f"{path}/embeddings.parquet")
    old = ann_graph.SHARD_ROWS
    found = ann_graph.nearest(spark.read.parquet(f"{path}/embeddings.parquet"), F.col("vec_id") % 100 == 0, shard_rows=400)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert ann_graph.SHARD_ROWS == old and set(got) == set(range(0, 1500, 100)) | set(range(2000, 2700, 100)) | {3600, 3700}
    assert ann_graph.recall(df, found, F.col("vec_id") % 100 == 0) >= 0.9
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1)) and hits == sorted(hits, key=lambda h: (h[1], h[2]))
        assert all(h[2] != q for h in hits)
    assert [h[2] for h in got[2100]] == [7] + list(range(2000, 2009)) and got[3600] == [(1, 1.0, 3700)]
    assert queries.op4_graph_neighbours(spark, path).count() == sum(map(len, got.values()))


def test_neighbours_empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    assert queries.op4_graph_neighbours(spark, path).count() == 0


def test_item_ids_of_any_type(spark):
    items = spark.createDataFrame([("q1", "seven green birds sat on the old wall"), (None, "a lone item without any id at all")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x seven green birds sat on the old wall y"), (2, "a lone item without any id at all"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {1: ["q1"], 2: [None], 3: []}
