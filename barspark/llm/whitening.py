"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Entries become integers x = floor(SCALE * c). The model is fitted on the distinct integer vectors
(copies weigh nothing, however many there are). Spark sums the vectors and their centred products by
task; only one dimension x dimension matrix per task, and one in all, leaves the executors. Centring
is split in two: the nearest whole number is taken off each entry before multiplying, which keeps
the products exact, and the remaining half unit at most is taken off the sum.

The covariance C = L L' is factored with diagonal pivoting up to its rank. Jacobi rotations then make
the columns of L orthogonal: their squared norms are the eigenvalues of C, the normalised columns its
eigenvectors. Small eigenvalues keep their relative accuracy, since C is never multiplied again.

Defined cases: a null vector, and one with a null or non-finite entry, is dropped; so is a vector of
another length than the most frequent one (the longest of equally frequent ones), empty ones
included; values beyond 64 bits stop at the ends of that range; components of no variance are left out, so a
table of equal vectors has none; repeated rows are all returned; an empty table gives an empty model
and result; a ``deviation`` beyond 64 bits is null; input columns called like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import cut, drop, packed, unpacked

# Production parameters of op12.
SCALE = 256
COMPONENTS = 4
SWEEPS = 60
LONG = 1 << 63


@dataclass
class Whitening:
    n: int                    # distinct vectors
    sums: list[int]           # per dimension, exact
    components: np.ndarray    # unit eigenvectors as rows, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, the whole part taken off in integers."""
        whole, rest = _centre(self.n, self.sums)
        return _off(x, whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - sums)^2 in exact integers; None beyond 64 bits."""
        reach = self.n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if reach * reach * max(1, x.shape[1]) < LONG else object
        off = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [int(v) if v < LONG else None for v in (off * off).sum(axis=1)]


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, dtype=np.int64), np.array([(s - w * n) / n for s, w in zip(sums, whole)], dtype=float)


def _off(x: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """x - whole: in integers, unless that could leave their range."""
    if np.abs(x.astype(float)).max(initial=0.0) < LONG / 4:
        return (x - whole).astype(float)
    return x.astype(float) - whole


def pivoted_cholesky(c: np.ndarray) -> np.ndarray:
    """L with c = L L', one column per pivot; stops at the numerical rank."""
    d = len(c)
    left, factor = np.diag(c).copy(), np.zeros((d, 0))
    least = 8 * d * np.finfo(float).eps * left               # what rounding leaves of a dependent dimension
    used = np.zeros(d, dtype=bool)
    while factor.shape[1] < d:
        p = int(np.argmax(np.where(used | (left <= least), 0.0, left)))
        if used[p] or left[p] <= least[p]:
            break
        column = (c[:, p] - factor @ factor[p]) / np.sqrt(left[p])
        column[used] = 0.0    # rows of earlier pivots: the factor is triangular in pivot order
        column[p] = np.sqrt(left[p])
        used[p] = True
        left = left - column * column
        factor = np.column_stack([factor, column])
    return factor


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows) of L L' by rotating pairs of columns of L.

    A sweep meets every pair once, in rounds of disjoint pairs that turn at the same time.
    """
    g = factor.copy()
    r = g.shape[1]
    ring = list(range(r)) + ([-1] if r % 2 else [])
    for _ in range(SWEEPS if r > 1 else 0):
        worst = 0.0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if a >= 0 and b >= 0]
            p, q = (np.array(x, dtype=int) for x in zip(*pairs))
            a, b, ab = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            cosine = np.abs(ab) / np.sqrt(a * b)
            worst = max(worst, float(cosine.max()))
            turn = ab != 0                                   # however small: a far larger column would show through
            zeta = (b - a) / np.where(turn, 2 * ab, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = c * g[:, p] - c * t * g[:, q], c * t * g[:, p] + c * g[:, q]
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if worst <= 4 * np.finfo(float).eps * len(factor):
            break
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    vectors = (g / norms).T[order]
    heads = vectors[np.arange(r), np.abs(vectors).argmax(1)] if r else np.ones(0)
    return norms[order] ** 2, vectors * np.where(heads < 0, -1.0, 1.0)[:, None]


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def integer_vector(vector: Column) -> Column:
    """floor(SCALE * c) of each entry; null for a null vector or one with a null or non-finite entry."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows whose ``x`` has the usual length, and that length."""
    rows = rows.where("x is not null")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    return rows.where(F.size("x") == d), d


def _summed(df: DataFrame, d: int, products) -> np.ndarray:
    """Sum over all rows of ``products(block)``, a matrix; each task sends one matrix, by its rows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                block = products(_matrix(batch.column("x"), d))
                total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], ["i", "v"])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1], "v": [np.sum(np.stack(group["v"]), axis=0)]})

    rows = (df.mapInArrow(partial, "i int, v array<double>").groupBy("i")
            .applyInPandas(together, "i int, v array<double>").collect())
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct integer vectors of ``df``."""
    usable, d = _usable(df.select(integer_vector(F.col(vector)).alias("x")))
    if not d:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    distinct = cut(usable.distinct(), "distinct")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * d
        for batch in batches:
            x = batch["x"]
            x = np.stack(x) if len(x) else np.zeros((0, d), dtype=np.int64)
            n += len(x)
            small = np.abs(x.astype(float)).max(initial=0.0) * max(1, len(x)) < LONG / 4
            total = [t + int(s) for t, s in zip(total, x.sum(0) if small else x.astype(object).sum(0))]
        yield pd.DataFrame({"i": range(-1, d), "v": [str(n), *map(str, total)]})

    exact = dict(distinct.mapInPandas(sums, "i int, v string").groupBy("i")
                 .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    n, total = int(exact[-1]), [int(exact[i]) for i in range(d)]
    whole, rest = _centre(n, total)

    def scatter(x: np.ndarray) -> np.ndarray:
        z = _off(x, whole)
        return z.T @ z

    covariance = _summed(distinct, d, scatter) / n - np.outer(rest, rest)
    covariance = (covariance + covariance.T) / 2
    values, vectors = jacobi(pivoted_cholesky(covariance))
    model = Whitening(n, total, vectors[:components], values[:components], float(np.trace(covariance)))
    k = len(model.eigenvalues)
    if k:
        def products(x: np.ndarray) -> np.ndarray:
            w = model.whitened(x)
            return np.vstack([w.T @ w, w.sum(0)])

        moments = _summed(distinct, d, products)
        mean = moments[-1] / n
        model.identity_error = float(np.abs(moments[:-1] / n - np.outer(mean, mean) - np.eye(k)).max())
    drop(distinct)
    return model


def transform(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector, with ``deviation`` and ``whitened``, one number per component."""
    d = len(model.sums)

    @F.pandas_udf("struct<deviation:bigint,whitened:array<double>>")
    def applied(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, d), dtype=np.int64)
        return pd.DataFrame({"deviation": pd.array(model.deviation(x), dtype="Int64"), "whitened": list(model.whitened(x))})

    rows = packed(df)
    rows = rows.withColumn("x", integer_vector(F.col("row").getField(vector)))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") == d) & F.lit(d > 0)).withColumn("y", applied("x"))
    return unpacked(rows.select("row", F.col("y.deviation").alias("deviation"), F.col("y.whitened").alias("whitened")),
                    "deviation", "whitened")
