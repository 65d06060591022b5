"""Vector search and the vector table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.scoring import cosine

#: Rows of a block of vectors or of queries, and queries compared at once.
BLOCK, AT_ONCE = 16_384, 128


def nearest(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """``query_id, vec_id, similarity``: the k most similar vectors of each query by cosine, ties by id.

    The queries are a stated, bounded set and go to every task; each task
    keeps k rows a query before anything is shuffled.
    """
    pool = vectors if where is None else vectors.where(where)
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    scored = pool.crossJoin(F.broadcast(q)).select("query_id", "vec_id", cosine(F.col("embedding"), F.col("query_vector")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id"))
    return scored.withColumn("place", rank).where(F.col("place") <= k)


def _best(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            table = table.sort_by("vec_id").combine_chunks()
            ids = table.column("vec_id").to_numpy()
            rows = table.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64)
            rows = rows.reshape(len(ids), -1)
            return ids, rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)

        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and vectors.num_rows:
            (q_ids, q), (ids, v) = matrix(queries), matrix(vectors)
            for at in range(0, len(q_ids), AT_ONCE):
                rows = []
                for query, near in zip(q_ids[at : at + AT_ONCE].tolist(), q[at : at + AT_ONCE] @ v.T, strict=True):
                    rounded = np.round(near, 9)
                    # all that are as near as the k-th; in order of id, so a stable sort decides ties
                    found = np.flatnonzero(rounded >= np.partition(rounded, -k)[-k]) if len(ids) > k else np.arange(len(ids))
                    found = found[np.argsort(-rounded[found], kind="stable")][:k]
                    rows.append((np.full(len(found), query), ids[found], near[found]))
                out.append(tuple(np.concatenate(c) for c in zip(*rows, strict=True)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "similarity"])

    return run


def nearest_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As ``nearest``, for queries that grow with the table: every block of queries meets every block of vectors in a task of its own."""
    vectors, queries = (t.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).where("embedding is not null") for t in (vectors, queries))
    blocks = {side: max(1, -(-t.count() // BLOCK)) for side, t in (("v", vectors), ("q", queries))}

    def dealt(t: DataFrame, side: str, other: str):
        t = t.withColumn(side, F.pmod(F.xxhash64("vec_id"), F.lit(blocks[side])).cast("int"))
        return t.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks[other] - 1)))).groupBy("q", "v")

    scored = dealt(queries, "q", "v").cogroup(dealt(vectors, "v", "q")).applyInArrow(_best(k), "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id"))
    return scored.withColumn("place", rank).where(F.col("place") <= k)


def upsert(table: DataFrame, changes: DataFrame) -> DataFrame:
    """table (id, vector, status) after changes (seq, id, vector, status): the last change of an id wins; a change without a vector only sets the status of a row that exists."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("vector", "status"), "seq").alias("c")).select("id", F.col("c.vector").alias("new_vector"), F.col("c.status").alias("new_status"))
    both = table.join(last, "id", "full_outer")
    out = both.select("id", F.coalesce("new_vector", "vector").alias("vector"), F.coalesce("new_status", "status").alias("status"))
    return out.where("vector is not null")
