"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Distinct vectors are dealt to shards of bounded size by hash. In each shard points are inserted in
batches: a greedy beam search from the medoid proposes neighbours, robust pruning keeps diverse
edges (a candidate goes if a kept one is ``ALPHA`` times nearer to it than the point is), and the
kept neighbours get an edge back, pruned again when they have too many. A shard's graph is one row
of a written index table. Queries come in blocks; every (block, shard) pair is one beam search, pairs
are a product of partitions, and each query's lists are merged. All distances are computed in double precision, in the graph on vectors
moved and scaled to their shard's own frame; a beam that ends short of k + 1 points takes all of its shard.

Equal vectors are one point that remembers its ``k + 1`` smallest ids, which is all a list of k
nearest can show of them: a vector that a third of the rows share costs no more than another.

Defined cases: vectors null, empty, zero or with null or non-finite components, and rows without
id, take no part; vectors of different length are never compared; repeated rows count once; ties go
to the smaller id; fewer than k candidates give a shorter list; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import cut

# Production parameters of op4.
K = 10
QUERY_EVERY = 100
SHARD_ROWS = 4096
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 28, 48, 96, 1.2
BATCH = 512
BLOCK_QUERIES = 4096
TASKS, TASK_BYTES = 256, 32 << 20  # tasks of a search from which on one takes several shards, and bytes of those
INDEX = "dim int, shard long, n long, medoid int, ids binary, vectors binary, edges binary"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] to each of b[i, :] (points are in their shard's frame, so the product form is safe)."""
    return norms(a)[:, None] + norms(b) - 2 * np.matmul(b, a[:, :, None])[:, :, 0]


def norms(a: np.ndarray) -> np.ndarray:
    return np.einsum("...k,...k->...", a, a)


def robust_prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, dist: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Rows of ``cand`` (ids, -1: none) with squared ``dist`` to their point -> kept edges, padded with -1."""
    dist = np.where((cand < 0) | (cand == points[:, None]), np.inf, dist)
    order = np.lexsort((cand, dist), axis=1)
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    dist[:, 1:][cand[:, 1:] == cand[:, :-1]] = np.inf  # repeated candidates
    vec = x[np.maximum(cand, 0)]
    size = norms(vec)
    between = size[:, :, None] + size[:, None, :] - 2 * np.matmul(vec, vec.transpose(0, 2, 1))
    out = np.full((len(points), degree), -1, dtype=np.int32)
    rows = np.arange(len(points))
    for r in range(degree):
        pick = dist.argmin(1)
        best = dist[rows, pick]
        live = np.isfinite(best)
        if not live.any():
            break
        chosen = cand[rows, pick]
        out[live, r] = chosen[live]
        covered = ALPHA * ALPHA * between[rows, pick] <= dist
        dist[covered & live[:, None]] = np.inf
        dist[rows, pick] = np.inf
    return out


@dataclass
class Graph:
    x: np.ndarray      # points (n, d) in their frame
    edges: np.ndarray  # (n, DEGREE), -1: none
    medoid: int

    def beam(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search of all queries at once: (ids, squared distances), nearest first, -1: none."""
        m, n = len(q), len(self.x)
        ids = np.full((m, width), -1, dtype=np.int64)
        dist = np.full((m, width), np.inf)
        ids[:, 0], dist[:, 0] = self.medoid, squared(q, np.broadcast_to(self.x[self.medoid], (m, 1, q.shape[1])))[:, 0]
        done = np.ones((m, width), dtype=bool)
        done[:, 0] = False
        seen = np.zeros((m, n), dtype=bool)
        seen[:, self.medoid] = True
        active = np.arange(m)
        while len(active):
            d = np.where(done[active], np.inf, dist[active])
            pick = d.argmin(1)
            go = np.isfinite(d[np.arange(len(active)), pick])
            active, pick = active[go], pick[go]
            if not len(active):
                break
            done[active, pick] = True
            near = self.edges[ids[active, pick]].astype(np.int64)
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            a, b = np.nonzero(fresh)
            seen[active[a], near[a, b]] = True
            nd = np.where(fresh, squared(q[active], self.x[np.maximum(near, 0)]), np.inf)
            all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
            all_dist = np.concatenate([dist[active], nd], 1)
            all_done = np.concatenate([done[active], ~fresh], 1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            ids[active] = np.take_along_axis(all_ids, order, 1)
            dist[active] = np.take_along_axis(all_dist, order, 1)
            done[active] = np.take_along_axis(all_done, order, 1)
        return np.where(np.isfinite(dist), ids, -1), dist

    def link(self, points: np.ndarray) -> None:
        """Set edges of new points from a beam search, and edges back to them."""
        cand, dist = self.beam(self.x[points], BUILD_BEAM)
        self.edges[points] = robust_prune(self.x, points, cand, dist)
        self.link_back(points)

    def link_back(self, points: np.ndarray) -> None:
        src = np.repeat(points, self.edges.shape[1])
        dst = self.edges[points].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0].astype(np.int64)
        order = np.lexsort((src, dst))
        src, dst = src[order], dst[order]
        ends, first, counts = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, counts)
        added = np.full((len(ends), counts.max(initial=1)), -1, dtype=np.int64)
        added[np.repeat(np.arange(len(ends)), counts), place] = src
        own = self.edges[ends].astype(np.int64)
        for k in range(added.shape[1]):  # edges that are there already
            added[(added[:, k:k + 1] == own).any(1), k] = -1
        cand = np.concatenate([own, added], 1)
        for lo in range(0, len(ends), BATCH):
            part = slice(lo, lo + BATCH)
            p, c = ends[part], cand[part]
            c = c[:, (c >= 0).any(0)]
            dist = np.where(c >= 0, squared(self.x[p], self.x[np.maximum(c, 0)]), np.inf)
            few = (c >= 0).sum(1) <= self.edges.shape[1]
            kept = np.full((len(p), self.edges.shape[1]), -1, dtype=np.int32)
            if few.any():
                order = np.argsort(dist[few], axis=1, kind="stable")[:, :self.edges.shape[1]]
                near = np.take_along_axis(c[few], order, 1)
                kept[few, :near.shape[1]] = near
            if (~few).any():
                kept[~few] = robust_prune(self.x, p[~few], c[~few], dist[~few])
            self.edges[p] = kept


class Frame:
    """A shard's own origin and unit: the median of each component and a power of two near the median
    distance from there, so neither magnitude nor one odd vector takes the precision of the others."""

    FARTHEST = 2.0 ** 200  # vectors further away than this many units are drawn in to it (their direction stays)

    def __init__(self, points: np.ndarray):
        top = np.abs(points).max(initial=0)
        self.first = 2.0 ** -min(1000, max(-1000, math.frexp(top)[1]))  # to at most 1, so differences are finite
        self.origin = np.median(points * self.first, axis=0)
        away = np.abs(points * self.first - self.origin).max(1)
        typical = np.median(away) or away.max(initial=0)
        self.unit = 2.0 ** -min(1000, max(-1000, math.frexp(typical)[1]))

    def of(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", under="ignore"):
            x = np.clip(v * self.first, -2.0 ** 500, 2.0 ** 500) - self.origin
            size = np.abs(x).max(1, keepdims=True)
            far = size * self.unit > self.FARTHEST
            x = np.where(far, x / np.where(far, size, 1) * self.FARTHEST, x * np.where(far, 1, self.unit))
        return np.ascontiguousarray(x)


def distances(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distance of each q to its points, scaled where squares leave the range of a double."""
    with np.errstate(over="ignore", under="ignore"):
        diff = points - q[:, None, :]
        total = (diff ** 2).sum(2)
        out = np.sqrt(total)
        odd = (total < 1e-250) | (total > 1e250)
        if odd.any():
            size = np.abs(diff[odd]).max(1)
            inside = np.isfinite(size) & (size > 0)
            unit = np.where(inside, size, 1)[:, None]
            out[odd] = np.where(inside, size * np.sqrt(((diff[odd] / unit) ** 2).sum(1)), size)
    return out


def build(points: np.ndarray) -> Graph:
    """Graph over points; the result depends only on their order."""
    x = Frame(points).of(points)
    n = len(x)
    medoid = int(norms(x).argmin())
    g = Graph(x, np.full((n, DEGREE), -1, dtype=np.int32), medoid)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    done, size = 1, 8
    while done < n:  # batches double up to BATCH, so early points see a graph that has most of them
        points = order[done:done + size]
        g.link(points)
        done, size = done + len(points), min(BATCH, 2 * size)
    for lo in range(0, n, BATCH):  # a second round, now against the whole graph
        points = order[lo:lo + BATCH]
        cand, dist = g.beam(x[points], BUILD_BEAM)
        old = g.edges[points].astype(np.int64)
        cand = np.concatenate([cand, old], 1)
        dist = np.concatenate([dist, squared(x[points], x[np.maximum(old, 0)])], 1)
        g.edges[points] = robust_prune(x, points, cand, dist)
        g.link_back(points)
    return g


def usable(v: Column) -> Column:
    d = lambda x: x.cast("double")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(d(x)) | (F.abs(d(x)) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)


def distinct_vectors(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(rep, vector, ids): distinct usable vectors with their k + 1 smallest ids; rep is the smallest."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).distinct()
    smallest = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return (rows.withColumn("n", smallest).where(F.col("n") <= k + 1)
            .groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
            .select(F.element_at("ids", 1).alias("rep"), "vector", "ids"))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its points and graph."""
    sizes = {r[0]: r[1] for r in vectors.groupBy(F.size("vector")).count().collect()}  # one row per length
    shards = F.lit(1)
    for dim, n in sizes.items():
        shards = F.when(F.size("vector") == dim, math.ceil(n / shard_rows)).otherwise(shards)
    dealt = vectors.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), shards).alias("shard"), "rep", "vector")

    def graph_row(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        original = np.array(pdf["vector"].tolist(), dtype=np.float64)
        g = build(original)
        return pd.DataFrame([(key[0], key[1], len(pdf), g.medoid, pdf["rep"].to_numpy(np.int64).tobytes(),
                              original.tobytes(), g.edges.tobytes())],
                            columns=["dim", "shard", "n", "medoid", "ids", "vectors", "edges"])

    return cut(dealt.groupBy("dim", "shard").applyInPandas(graph_row, INDEX), "graphs")


def found_in(index: dict, reps: np.ndarray, vectors: np.ndarray, k: int, beam: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, point, score) of the k + 1 nearest points of a shard (a row of the index), BATCH queries at a time."""
    ids = np.frombuffer(index["ids"], dtype=np.int64)
    original = np.frombuffer(index["vectors"], dtype=np.float64).reshape(len(ids), -1)
    edges = np.frombuffer(index["edges"], dtype=np.int32).reshape(len(ids), -1)
    frame = Frame(original)
    g = Graph(frame.of(original), edges, index["medoid"])
    order = np.argsort(reps, kind="stable")
    for lo in range(0, len(order), BATCH):
        part = order[lo:lo + BATCH]
        q = vectors[part]
        found, _ = g.beam(frame.of(q), beam)
        for i in np.flatnonzero((found >= 0).sum(1) < min(k + 1, len(ids), beam)):  # a beam cut off: all points
            nearest_of_all = np.lexsort((ids, distances(q[i:i + 1], original[None])[0]))[:beam]
            found[i] = -1
            found[i, :len(nearest_of_all)] = nearest_of_all
        exact = np.where(found < 0, np.inf, distances(q, original[np.maximum(found, 0)]))
        points = np.where(found >= 0, ids[np.maximum(found, 0)], np.iinfo(np.int64).max)
        best = np.lexsort((points, exact, found < 0), axis=1)[:, :k + 1]
        ok = np.take_along_axis(found >= 0, best, 1).ravel()
        points, exact = np.take_along_axis(points, best, 1), np.take_along_axis(exact, best, 1)
        yield np.repeat(reps[part], points.shape[1])[ok], points.ravel()[ok], exact.ravel()[ok]


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(rep, vector) queries -> (query, point, score): each query's k + 1 nearest points of every shard."""
    n_blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("rep"), F.lit(n_blocks))
    blocks = cut(queries.select(F.size("vector").alias("dim"), block.alias("block"), F.struct("rep", "vector").alias("q"))
                 .groupBy("dim", "block").agg(F.collect_list("q").alias("qs")).drop("block"), "blocks")  # BLOCK_QUERIES a block
    # Every block meets every shard of its length as a product of partitions: neither side is copied to a shuffle,
    # nor to the driver (sizes estimated for copies leave their number out, so a join of copies may be broadcast).
    shards, largest = index.agg(F.count("*"), F.max(F.col("n") * F.col("dim"))).first()
    together = max(1, blocks.count())
    a_task = max(1, min(math.ceil(shards * together / TASKS), TASK_BYTES // (16 * (largest or 1))))
    pairs = (index.repartitionByRange(max(1, math.ceil(shards / a_task)), "dim", "shard")
             .join(blocks.repartition(together).hint("shuffle_replicate_nl"), "dim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("medoid", "ids", "vectors", "edges")}
                qs = batch.column("qs")[i].values
                numbers = qs.field("vector").flatten().to_numpy(zero_copy_only=False)
                reps = qs.field("rep").to_numpy(zero_copy_only=False)
                for found in found_in(row, reps, np.asarray(numbers, dtype=np.float64).reshape(len(reps), -1), k, beam):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query", "point", "score"])

    return pairs.select("medoid", "ids", "vectors", "edges", "qs").mapInArrow(run, "query long, point long, score double")


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K,
            shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): k nearest rows found for each row where ``is_query`` holds."""
    vectors = cut(distinct_vectors(df, key, vector, k), "vectors")
    asked = (df.where(is_query).select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("vector"))
             .where(F.col("query_id").isNotNull() & usable(F.col("vector"))).distinct()
             .join(vectors.select("vector", "rep"), "vector").select("query_id", "rep", "vector"))
    asked = cut(asked, "asked")
    index = build_index(vectors, shard_rows)
    hits = search(index, asked.select("rep", "vector").distinct(), k, beam)

    def first(rows: DataFrame, by: str, n: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(by).orderBy("score", "vec_id"))
        return rows.withColumn("rank", place).where(F.col("rank") <= n)

    # k + 1 nearest points hold k + 1 nearest ids: each point shows its k + 1 smallest, the first of them is its name.
    hits = first(hits.withColumnRenamed("point", "vec_id"), "query", k + 1).withColumnRenamed("vec_id", "point")
    named = (hits.join(vectors.select(F.col("rep").alias("point"), "ids"), "point")
             .select("query", "score", F.explode("ids").alias("vec_id")))
    lists = first(named, "query", k + 1).drop("rank")
    own = (asked.select("query_id", "rep").join(lists, F.col("rep") == F.col("query"))
           .where("vec_id <> query_id").select("query_id", "vec_id", "score"))
    return first(own, "query_id", k).select("query_id", "rank", "vec_id", "score")


def recall(df: DataFrame, found: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> float:
    """Part of the true k nearest distances that ``found`` reaches; brute force, for evaluation on small tables."""
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(key, vector, is_query.alias("asked")).distinct().toPandas()
    got = found.toPandas().groupby("query_id")["score"].apply(list).to_dict()
    hit = total = 0
    for _, same in rows.groupby(rows[vector].map(len)):
        ids, x = same[key].to_numpy(), np.array(same[vector].tolist(), dtype=np.float64)
        for i in np.flatnonzero(same["asked"].to_numpy(dtype=bool)):
            want = np.sort(np.sqrt(((x - x[i]) ** 2).sum(1))[ids != ids[i]])[:k]
            total += len(want)
            hit += sum(s <= want[-1] + 1e-9 for s in got.get(ids[i], [])) if len(want) else 0
    return hit / max(1, total)
