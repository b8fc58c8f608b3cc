"""The Jaccard join against all pairs by brute force."""

import random
import re

from pyspark.sql import Row

from barspark.llm import components, ngram_join, queries
from tests.llm.util import documents_dir


def shingle_set(t, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return set(zip(*[w[i:] for i in range(n)])) if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n=4, percent=85):
    sets = [shingle_set(r.text, n) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    return sorted((str(r.doc_id), len(sets[i]), str(least.get(root(i)) if sets[i] else r.doc_id)) for i, r in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    texts = []
    for _ in range(60):
        texts.append([rng.choice(vocab) for _ in range(rng.randint(1, 80))] + passage * rng.randint(0, 1))
    base = [rng.choice(vocab) for _ in range(90)]
    for _ in range(150):  # near copies of one text, around the threshold
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(t)
    chain = [rng.choice(vocab) for _ in range(60)]
    for _ in range(25):  # each differs a little from the one before
        chain = chain[1:] + [rng.choice(vocab)]
        texts.append(list(chain))
    out = [" ".join(t) for t in texts] + ["Just Three\twords", "just three words", "", None, " \n", "one", "ONE", "a b c d", "A  B c\nd", "é É"]
    out += [out[5].upper()] * 4 + [out[70]] * 20 + ["long " * 30000]
    rng.shuffle(out)
    rows = [Row(doc_id=i, text=t, component_id="clash", c="x") for i, t in enumerate(out)]
    return rows + [Row(doc_id=3, text=rows[3].text, component_id="", c=""), Row(doc_id=None, text="a b c d", component_id="", c=""),
                   Row(doc_id=None, text="quite alone with no id here", component_id="", c="")]


def test_components_match_brute_force(spark, tmp_path_factory, monkeypatch):
    rows = corpus(11)
    path = documents_dir(spark, tmp_path_factory, rows)
    monkeypatch.setattr(ngram_join, "GROUP", 8)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in queries.op6_ngram_join(spark, path).collect())
    assert got == brute(rows)


def test_keep_one(spark, tmp_path_factory):
    rows = corpus(12)
    rows = rows[:120] + [Row(doc_id=None, text=f"no id number {i} but words of its own {i}", component_id="", c="") for i in range(3)]
    df = spark.read.parquet(documents_dir(spark, tmp_path_factory, rows) + "/documents.parquet")
    kept = ngram_join.keep_one(df, words=5, percent=80)
    assert kept.columns == df.columns
    want = {c for _, n, c in brute(rows, 5, 80) if n and c != "None"}
    empty = [r for r in rows if not shingle_set(r.text)]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*want, *(str(r.doc_id) for r in empty), *["None"] * 3])


def test_components_of_long_chains(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1002), (1002, 1001), (5000, 5000)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {i: 1000 for i in (1000, 1001, 1002)}


def test_empty(spark, tmp_path_factory):
    assert queries.op6_ngram_join(spark, documents_dir(spark, tmp_path_factory, [])).count() == 0
