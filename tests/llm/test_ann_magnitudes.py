"""Nearest neighbours at any finite magnitude: ten rows for each query and the recall of ordinary vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import ann_graph


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def points(unit, odd=None):
    x = np.random.default_rng(1).normal(size=(1200, 12)) * unit
    if odd is not None:
        x[7] = odd
        x[100] = -2 * odd  # a query
    return x


@pytest.mark.parametrize("unit,odd", [(1e-25, None), (1e20, None), (1.0, 1e7), (1.0, 1e12), (1e-200, None), (1e200, None), (1.0, 1e300)])
def test_rows_and_recall(spark, unit, odd):
    x = points(unit, odd)
    found = ann_graph.nearest(table(spark, x), F.col("vec_id") % 100 == 0, shard_rows=600)
    rows = found.collect()
    assert sorted((r.query_id, r["rank"]) for r in rows) == [(q, k) for q in range(0, 1200, 100) for k in range(1, 11)]
    hit = 0
    for q in range(0, 1200, 100):
        d = ann_graph.distances(x[q:q + 1], x[None])[0]
        d[q] = np.inf
        hit += sum(r.score <= np.sort(d)[9] for r in rows if r.query_id == q)  # a tied vector is as near
    assert hit >= 0.95 * len(rows)


def test_distances_are_the_plain_ones_where_squares_fit():
    x = points(3.0)
    plain = np.sqrt(((x[5:] - x[:1]) ** 2).sum(1))
    assert (ann_graph.distances(x[:1], x[None, 5:])[0] == plain).all()
    for unit in (1e-220, 1e220):
        assert np.allclose(ann_graph.distances(x[:1] * unit, x[None, 5:] * unit)[0], plain * unit, rtol=1e-12)


def test_a_cut_off_beam_takes_the_whole_shard(spark, monkeypatch):
    whole = ann_graph.build

    def broken(x):
        g = whole(x)
        g.edges[:] = -1
        return g

    monkeypatch.setattr(ann_graph, "build", broken)
    df = table(spark, points(1.0))
    found = ann_graph.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=600)
    assert ann_graph.recall(df, found, F.col("vec_id") % 100 == 0) == 1.0
