"""The search of shards: queries meet shards without copies of either, one or several pairs a task."""

import numpy as np
import pytest

from barspark.llm import ann_graph


@pytest.fixture(scope="module")
def searched(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(v) for v in rng.normal(size=d)]) for i in range(400) for d in (3 + 3 * (i % 4 == 0),)]
    vectors = spark.createDataFrame(rows, "rep long, vector array<double>").cache()
    return rows, ann_graph.build_index(vectors, 40), vectors.where("rep % 5 < 2")


@pytest.mark.parametrize("tasks", [1, 256])
def test_no_copies_of_queries_or_shards(searched, monkeypatch, tasks):
    rows, index, queries = searched
    monkeypatch.setattr(ann_graph, "BLOCK_QUERIES", 30)
    monkeypatch.setattr(ann_graph, "TASKS", tasks)
    found = ann_graph.search(index, queries, 3)
    got = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "BroadcastExchange" not in plan, plan
    vectors, shard = dict(rows), {}
    for r in index.select("dim", "shard", "ids").collect():
        shard |= {int(i): (r.dim, r.shard) for i in np.frombuffer(r.ids, dtype=np.int64)}
    want = []
    for q in (i for i in vectors if i % 5 < 2):
        for s in set(shard.values()):
            if s[0] == len(vectors[q]):
                near = sorted((float(np.linalg.norm(np.subtract(vectors[q], vectors[p]))), p) for p in vectors if shard[p] == s)
                want += [(q, p, round(d, 9)) for d, p in near[:4]]
    assert sorted((r["query"], r.point, round(r.score, 9)) for r in got) == sorted(want)
