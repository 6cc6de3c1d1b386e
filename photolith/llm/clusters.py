"""Centroid clustering in exact integers, screened in single precision.

A vector's components become the integers floor(SCALE * x). Centroids 0, 1, ... start as the `k` vectors whose ids have the
smallest sha256 of `1:<id>`. Each round assigns every vector to its nearest centroid (squared Euclidean distance, ties to the smaller
number) and replaces every centroid that got vectors by the componentwise floor of their mean.

Nearest centroids are found by screening. One matrix product in float32 gives every |c|^2 - 2 x.c with an error that has a
proven bound: the dot product of d terms, summed in any order, is off by at most gamma(d + 2) * |x| * |c|, where gamma(n) =
n u / (1 - n u), u = 2^-24, and two of the d + 2 roundings are those of the inputs. So each centroid has an interval, and those whose
interval begins above the least upper end can't be nearest. Where more than one is left the distances are computed in
64-bit integers, which also settles ties; the distance returned is always computed so.

A round is one pass over the vectors: each task keeps the sums and counts of k centroids, which Spark adds up.
The driver sees k * dim sums a round, and k centroids go out with the tasks. The passes read the source anew; the last assignment
is written once, narrow, and read for its totals.

Defined cases: vectors that are null, of another length, or with null or non-finite components aren't kept, nor are those with a component
of 2^21 or more, whose squared distances needn't fit a long; a null id comes after all others when centroids are chosen, and rows
with one id by their components; repeated rows count each; fewer vectors than k make fewer centroids, none give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolith.llm._bytes import bound_batches, columns
from photolith.llm._store import stored
from photolith.llm._vectors import matrix

K, ROUNDS, DIM, SCALE = 16, 3, 64, 64
LARGEST = float(1 << 21)
UNIT = 2.0**-24


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the rows that are kept, and their components as integers."""
    rows, x = matrix(column, dim)
    with np.errstate(invalid="ignore"):
        fine = (np.abs(x) < LARGEST).all(axis=1)  # neither NaN nor infinite, either
    return rows[fine], np.floor(x[fine] * SCALE).astype(np.int64)


class Screen:
    """Finds nearest centroids: intervals from a float32 product first, integers where they overlap."""

    def __init__(self, centroids: np.ndarray):
        self.exact = np.asarray(centroids, dtype=np.int64)
        wide = self.exact.astype(np.float64)
        self.single = np.ascontiguousarray(self.exact.astype(np.float32).T)
        self.square = np.square(wide).sum(axis=1)
        self.norm = np.sqrt(self.square)
        n = self.exact.shape[1] + 4  # two roundings of inputs, and two to spare for those of the norms
        self.gamma = n * UNIT / (1 - n * UNIT)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends, for every vector and centroid, of the squared distance without |x|^2."""
        dot = (x.astype(np.float32) @ self.single).astype(np.float64)
        norm = np.sqrt(np.square(x.astype(np.float64)).sum(axis=1))
        middle = self.square - 2 * dot
        slack = 2 * self.gamma * norm[:, None] * self.norm + 2.0**-50 * (self.square + 2 * np.abs(dot))
        return middle - slack, middle + slack

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, and the squared distance to it."""
        low, high = self.intervals(x)
        open_ = low <= high.min(axis=1)[:, None]
        best = open_.argmax(axis=1)
        unsure = np.flatnonzero(open_.sum(axis=1) > 1)
        if len(unsure):
            row, c = np.nonzero(open_[unsure])
            d = np.empty(len(row), dtype=np.int64)
            for at in range(0, len(row), 1 << 14):
                part = slice(at, at + (1 << 14))
                d[part] = np.square(x[unsure[row[part]]] - self.exact[c[part]]).sum(axis=1)
            order = np.lexsort((c, d, row))
            best[unsure] = c[order[np.searchsorted(row[order], np.arange(len(unsure)))]]
        return best, np.square(x - self.exact[best]).sum(axis=1)


def first_centroids(rows: DataFrame, k: int, dim: int) -> np.ndarray:
    """The integers of the k vectors with the smallest hashes, in their order; each batch passes on k at most."""

    def run(batches):
        for batch in batches:
            at, x = integers(batch.column(1), dim)
            h = np.array([v or "~" for v in batch.column(0).take(pa.array(at)).to_pylist()], dtype=object)
            order = np.lexsort((*x.T[::-1], h))[:k] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(h[order], type=pa.string()), pa.array(x[order].tolist(), type=pa.list_(pa.int64()))], names=["h", "x"])

    hashed = rows.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    found = hashed.mapInArrow(run, "h string, x array<long>").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in found], dtype=np.int64).reshape(len(found), dim)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dim = centroids.shape

    def run(batches):
        screen = Screen(centroids)
        total, count = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            _, x = integers(batch.column(0), dim)
            if len(x):
                best, _ = screen.nearest(x)
                order = np.argsort(best, kind="stable")
                own, first = np.unique(best[order], return_index=True)
                total[own] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(best, minlength=k)
        used = np.flatnonzero(count)
        parts = (np.repeat(used, dim).astype(np.int32), np.tile(np.arange(dim, dtype=np.int32), len(used)), np.repeat(count[used], dim), total[used].reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["cluster", "component", "n", "total"])

    parts = rows.select("embedding").mapInArrow(run, "cluster int, component int, n long, total long")
    summed = parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in summed.collect():
        out[r.cluster, r.component] = int(r.total) // r.n
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector that is kept."""
    dim = centroids.shape[1]

    def run(batches):
        screen = Screen(centroids)
        for batch in batches:
            at, x = integers(batch.column(1), dim)
            if len(x):
                best, distance = screen.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    spark = df.sparkSession
    bound_batches(df)
    rows = columns(df, vec_id=id_col, embedding=vector_col)
    result = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(rows, k, dim)
    if not len(centroids):
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    last = stored(assigned(rows, centroids), "clustered")
    sums = {r.cluster: int(r.total) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia = sum(sums.values())
    known = spark.createDataFrame([(c, total, inertia, digest(centroids[c])) for c, total in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(known), "cluster").select(*[x.split()[0] for x in result.split(", ")])  # k rows
