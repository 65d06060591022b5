"""Centroid clustering of embeddings with partial-distance search.

Vectors become integers, so every distance and every mean is exact and the
result depends neither on the order of rows nor on how they are dealt. The
table of integers is written once; a round reads it where it lies and sends
on only sums by cluster, so no vector is shuffled. Driver and workers hold
the centroids and the order of dimensions, which don't grow with the table.

Partial-distance search: dimensions go by falling variance over the whole
table. A vector starts with the whole distance to one centroid, the nearest in
the first dimensions. Squared differences to every other centroid are added
up a few dimensions at a time, and the centroid is abandoned as soon as the
sum is strictly above the best whole distance; only what is left at the end
has finished all dimensions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Dimensions that are added before sums are held against the best distance.
STEP = 8
#: Sum of a vector's squared integers from which on distances might not fit a long.
MOST_SQUARES = 2.0**60
#: Vectors that are compared at once.
ROWS_AT_ONCE = 8192


@dataclass(frozen=True)
class Search:
    """Centroids, in the order of their numbers, and the order in which dimensions are added."""

    centroids: np.ndarray
    order: np.ndarray
    step: int = STEP

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each row of x (ties: smaller number), and how many differences were squared."""
        x, c = x[:, self.order], self.centroids[:, self.order]
        n, (k, width) = len(x), c.shape
        head = np.stack([((x[:, : self.step] - c[j, : self.step]) ** 2).sum(1) for j in range(k)], axis=1)
        best = head.argmin(1)
        distance = head[np.arange(n), best] + ((x[:, self.step :] - c[best, self.step :]) ** 2).sum(1)
        first, work = best.copy(), n * (k * min(self.step, width) + max(0, width - self.step))
        for j in range(k):
            at = np.flatnonzero((head[:, j] <= distance) & (first != j))
            partial = head[at, j]
            for d in range(self.step, width, self.step):
                if not len(at):
                    break
                block = x[at, d : d + self.step] - c[j, d : d + self.step]
                partial = partial + (block**2).sum(1)
                work += block.size
                open_ = partial <= distance[at]
                at, partial = at[open_], partial[open_]
            better = (partial < distance[at]) | (j < best[at])  # what is left isn't farther
            best[at[better]], distance[at[better]] = j, partial[better]
        return best, distance, work


def cells(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """``vec_id, cells``: the usable vectors, each component x as floor(scale * x)."""
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale * F.when(F.abs(x.cast("double")) < 2.0**40, 1.0))).alias("cells"), F.col(vector_col).alias("v"))
    whole = (F.size("v") == width) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0**40))
    squares = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return plain.where(F.coalesce(whole, F.lit(False))).where(squares < MOST_SQUARES).select("vec_id", "cells")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def moments(table: DataFrame, width: int) -> list[int]:
    """n * sum of squares - square of the sum, of each dimension over the whole table."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, float(len(x)))), pa.array(x.sum(0)), pa.array((x**2).sum(0))], names=["dim", "n", "s", "q"])

    found = table.select("cells").mapInArrow(sums, "dim int, n double, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    return [r["n"] * r["q"] - r["s"] ** 2 for r in sorted(found, key=lambda r: r["dim"])]


def first_centroids(table: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in that order; equal ids go by their integers, rows without an id come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    taken = table.select(key.alias("key"), "cells").orderBy(F.col("key").asc_nulls_last(), "cells").limit(clusters).collect()
    return np.array([r["cells"] for r in taken], dtype=np.int64)


def means(table: DataFrame, search: Search) -> np.ndarray:
    """One round: each centroid's vectors' exact floored means; a centroid without vectors stays."""
    width, k = search.centroids.shape[1], len(search.centroids)
    shared = table.sparkSession.sparkContext.broadcast(search)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)  # last column: how many vectors
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for at in range(0, len(x), ROWS_AT_ONCE):
                part = x[at : at + ROWS_AT_ONCE]
                near = shared.value.nearest(part)[0]
                for j in np.unique(near).tolist():
                    own = part[near == j]
                    total[j, :width] += own.sum(0)
                    total[j, width] += len(own)
        some = np.flatnonzero(total[:, width])
        cluster, dim = np.repeat(some, width + 1), np.tile(np.arange(width + 1), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(total[some].ravel())], names=["cluster", "dim", "s"])

    found = table.select("cells").mapInArrow(sums, "cluster int, dim int, s long").groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # clusters x dimensions
    total = {(r["cluster"], r["dim"]): int(r["s"]) for r in found}
    shared.unpersist()
    return np.array([[total[j, d] // total[j, width] for d in range(width)] if (j, width) in total else search.centroids[j] for j in range(k)], dtype=np.int64)


def assigned(table: DataFrame, search: Search) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    width = search.centroids.shape[1]
    shared = table.sparkSession.sparkContext.broadcast(search)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                near, distance, _ = shared.value.nearest(_matrix(part.column(1), width))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.select("vec_id", "cells").mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each usable vector.

    Usable are vectors of exactly ``width`` components, none null or not
    finite; a component x counts as floor(scale * x). (Also left out are
    vectors whose squares sum to 2**60 or more: their distances don't fit a
    long.) The first centroids are the vectors with the least sha256 of
    ``seed:id``. Each of ``rounds`` rounds assigns every vector to the nearest
    centroid, ties to the smaller number, and takes the floored means; an
    empty centroid stays as it is. Then all are assigned once more.

    Fewer vectors than clusters give as many centroids as there are vectors,
    an empty table no rows. Rows that repeat an id are vectors of their own;
    rows without an id are assigned too, but are first centroids only where
    ids run out. Equal vectors may be two centroids; the smaller number has
    them all. Other columns are not looked at. A sum of distances that doesn't
    fit a long is null.
    """
    spark = vectors.sparkSession
    table = written(cells(vectors, id_col, vector_col, width, scale), "kmeans-cells")
    centroids = first_centroids(table, clusters, seed)
    if not len(centroids):
        return table.selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    order = np.argsort([-m for m in moments(table, width)], kind="stable")
    for _ in range(rounds):
        centroids = means(table, Search(centroids, order))
    out = written(assigned(table, Search(centroids, order)), "kmeans-assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    total = sum(inertia.values())
    fits = lambda n: n if n < 1 << 63 else None
    about = [(j, fits(n), fits(total), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in inertia.items()]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
