"""Connected components by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
The edges of a task are contracted first by union-find, to a star for each
component of theirs; a task has at most about BLOCK_EDGES edges. Then large
and small stars alternate until a round changes nothing. Each step is a
grouped minimum, added up before the shuffle, and a join of two plain tables,
so a node with very many edges is never gathered in one task; each round is
written to the shared folder, so no lineage grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed_join, written

#: Edges that one task contracts.
BLOCK_EDGES = 1 << 19


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, least node of its component) of the edges of this task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    pairs = [(n, find(n)) for n in root]
    stars = [(n, r) for n, r in pairs if n != r]
    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], names=["u", "v"])


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Edges (u, v) after one step; u > v in the result.

    Large: each node links its larger neighbours to the least of its
    neighbourhood and itself. Small: each node links its smaller neighbours
    and itself to their least.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = keyed_join(around, least.coalesce(parts), ["u"], "inner", "star-least")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components", block_edges: int = BLOCK_EDGES) -> DataFrame:
    """``node, component`` for every node of edges ``a, b``: the least node it can reach.

    Self-loops, repeated edges and edges with a null end count for nothing.
    No edges, no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    pairs = written(pairs, f"{name}-edges")
    blocks = max(1, -(-pairs.count() // block_edges))
    current = written(pairs.repartition(blocks).mapInArrow(_contract, "u long, v long"), f"{name}-0")
    state, turn = _digest(current), 0
    while state[0]:
        turn += 1
        # as many files as blocks: small tables aren't spread over all shuffle partitions
        large = written(_star(current, True, blocks).coalesce(blocks), f"{name}-large")
        after = written(_star(large, False, blocks).coalesce(blocks), f"{name}-{turn}")
        now = _digest(after)
        discard(large, current)
        current = after
        if now == state:
            break
        state = now
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal before and after a round means that nothing moved."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
