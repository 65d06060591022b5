"""Walks from very many seeds over import-like graphs, in cells of seeds.

A cell has some thousand seeds and the links that any of them may use; a task
walks it level by level, with a bit for each seed at each node. What is reached
grows with seeds times nodes, so it leaves the task as it is found and is never
shuffled. Cells whose links are too many for a task are walked by joins
(``graph.reach``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.graph import reach
from memlake.sources.scratch import written

#: Seeds of a cell: at most, and as few where that makes more tasks.
MOST_SEEDS, FEW_SEEDS = 8_192, 1_024
#: Links of a cell at most, targets of a row, and bytes of masks that are worked on at once.
MOST_LINKS, ROW_LINKS, MASK_BYTES = 2_000_000, 4_096, 32 << 20
#: Rows of a batch that leaves a task, and pairs of seeds and labels that are looked at at once, about.
BATCH_ROWS, LOOKED_AT = 200_000, 8 << 20
ROLES = {"seed": 0, "links": 1, "label": 2}


class _Cell:
    """The seeds, links and labels of a cell, by numbers."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        role = table.column("role").to_numpy()
        seeds, links, labels = (table.filter(pa.array(role == ROLES[k])).combine_chunks() for k in ("seed", "links", "label"))
        labels = labels.sort_by("label")
        tos = links.column("tos").combine_chunks()
        sizes = np.diff(tos.offsets.to_numpy())
        parts = [seeds.column("node_id"), links.column("node_id"), labels.column("node_id"), pa.chunked_array([tos.flatten()])]
        coded = pa.chunked_array([c for p in parts for c in p.chunks], seeds.schema.field("node_id").type).combine_chunks().dictionary_encode()
        self.nodes, code = len(coded.dictionary), coded.indices.to_numpy()
        self.seed_at, src, self.label_at, dst = np.split(code, np.cumsum([len(p) for p in parts[:3]]))
        src, order = np.repeat(src, sizes), np.argsort(dst, kind="stable")
        self.src, self.dst = src[order], dst[order]
        self.seeds, self.labels = seeds.column("node_id").combine_chunks(), labels.column("label").combine_chunks()

    def chunks(self) -> Iterator[tuple[int, int]]:
        """Ranges of seeds whose masks fit."""
        step = 64 * max(1, MASK_BYTES // (8 * max(1, len(self.src), self.nodes)))
        for low in range(0, len(self.seeds), step):
            yield low, min(low + step, len(self.seeds))

    def start(self, low: int, high: int) -> np.ndarray:
        masks = np.zeros((self.nodes, -(-(high - low) // 64) * 8), np.uint8)
        k = np.arange(high - low)
        np.bitwise_or.at(masks, (self.seed_at[low:high], k >> 3), (1 << (k & 7)).astype(np.uint8))
        return masks.view(np.uint64)

    def step(self, masks: np.ndarray) -> np.ndarray:
        """Masks of what is one link away."""
        used = masks.any(axis=1)[self.src]
        src, dst = self.src[used], self.dst[used]
        out = np.zeros_like(masks)
        if len(dst):
            first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
            out[dst[first]] = np.bitwise_or.reduceat(masks[src], first, axis=0)
        return out

    def reached(self, masks: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Seeds and the labels that they reach, by seed and label, for some seeds after others."""
        bits = masks.view(np.uint8)
        step = 8 * max(1, LOOKED_AT // (8 * max(1, len(self.label_at))))
        for low in range(0, n, step):
            some = np.unpackbits(bits[self.label_at, low // 8 : (low + step) // 8], axis=1, count=min(step, n - low), bitorder="little")
            seed, label = np.nonzero(np.ascontiguousarray(some.T))
            yield seed + low, label


def _all_reached(depth: int, seed_type: pa.DataType, label_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = _Cell(batches)
        for low, high in cell.chunks():
            here = cell.start(low, high)
            seen = here.copy()
            for d in range(1, depth + 1):
                here = cell.step(here) & ~seen
                seen |= here
                rows = max(1, BATCH_ROWS // (high - low))
                for at in range(0, len(cell.labels), rows):
                    some = np.unpackbits(here[cell.label_at[at : at + rows]].view(np.uint8), axis=1, count=high - low, bitorder="little")
                    label, seed = np.nonzero(some)
                    if len(label):
                        columns = [cell.seeds.take(pa.array(seed + low)).cast(seed_type), cell.labels.take(pa.array(label + at)).cast(label_type), pa.array(np.full(len(label), d, np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, ["seed", "label", "depth"])

    return run


def _nearest(depth: int, most: int, seed_type: pa.DataType, label_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = _Cell(batches)
        for low, high in cell.chunks():
            n = high - low
            here = cell.start(low, high)
            seen, have, parts = here.copy(), np.zeros(n, np.int64), []
            for d in range(1, depth + 1):
                here = cell.step(here) & ~seen
                seen |= here
                for seed, label in cell.reached(here, n):
                    counts = np.bincount(seed, minlength=n)
                    place = np.arange(len(seed)) - np.repeat(np.cumsum(counts) - counts, counts)
                    keep = place < (most - have)[seed]
                    parts.append((seed[keep], label[keep], np.full(int(keep.sum()), d, np.int32)))
                    have = np.minimum(most, have + counts)
                done = np.zeros(here.shape[1] * 64, np.uint8)
                done[:n] = have >= most
                here &= ~np.packbits(done, bitorder="little").view(np.uint64)
                if not here.any():
                    break
            seed, label, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(seed, kind="stable")  # levels stay in order
            some = np.flatnonzero(have)
            ends = np.concatenate([[0], np.cumsum(have[some])]).astype(np.int32)
            names = pa.ListArray.from_arrays(ends, cell.labels.take(pa.array(label[order])).cast(label_type))
            columns = [cell.seeds.take(pa.array(some + low)).cast(seed_type), names, pa.ListArray.from_arrays(ends, pa.array(at[order]))]
            yield pa.RecordBatch.from_arrays(columns, ["seed", "labels", "depths"])

    return run


def _cells(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool, labels: DataFrame, most_links: int) -> tuple[DataFrame, DataFrame, DataFrame | None, int]:
    """Rows of the cells (cell, role, node_id, tos, label), links, seeds that are left to joins, and the number of cells."""
    spark = edges.sparkSession
    a, b = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    links = written(edges.select(F.col(a).alias("node_id"), F.col(b).alias("to")).distinct(), "reach-links")
    degree = links.groupBy("node_id").agg(F.count("*").alias("degree"))
    part = F.pmod(F.xxhash64("to"), F.ceil(F.col("degree") / ROW_LINKS))
    lists = written(links.join(degree, "node_id").groupBy("node_id", part.alias("part")).agg(F.collect_list("to").alias("tos")).select("node_id", "tos"), "reach-lists")
    seeds = written(seeds.select("node_id").where("node_id is not null").distinct(), "reach-all-seeds")
    n = seeds.count()
    parts = max(1, -(-n // MOST_SEEDS), min(-(-n // FEW_SEEDS), 2 * spark.sparkContext.defaultParallelism))
    # neighbours in number are likely to share links
    dealt = seeds.repartitionByRange(parts, F.length("node_id"), "node_id").sortWithinPartitions(F.length("node_id"), "node_id").withColumn("n", F.monotonically_increasing_id())
    in_part = F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = written(dealt.select("node_id", (F.shiftright("n", 33) * (1 << 20) + F.floor(in_part / (2 * MOST_SEEDS))).cast("long").alias("cell")), "reach-seeds")
    levels, here = [dealt], dealt
    for d in range(1, depth + 1):
        moved = here.join(lists, "node_id").select("cell", F.explode("tos").alias("node_id")).distinct()
        before = levels[0]
        for level in levels[1:]:
            before = before.unionByName(level)
        here = written(moved.join(before, ["cell", "node_id"], "left_anti"), f"reach-cells-{d}")
        levels.append(here)
    sources, reached = levels[0], levels[0]
    for d, level in enumerate(levels[1:], 1):
        sources, reached = sources if d == depth else sources.unionByName(level), reached.unionByName(level)
    large = written(sources.join(degree, "node_id").groupBy("cell").agg(F.sum("degree").alias("links")).where(F.col("links") > most_links).select("cell"), "reach-large")
    left = None
    if not large.isEmpty():
        left = dealt.join(large, "cell", "left_semi").select("node_id")
        dealt, sources, reached = (x.join(large, "cell", "left_anti") for x in (dealt, sources, reached))
    rows = dealt.select("cell", F.lit(ROLES["seed"]).alias("role"), "node_id")
    rows = rows.unionByName(sources.join(lists, "node_id").select("cell", F.lit(ROLES["links"]).alias("role"), "node_id", "tos"), allowMissingColumns=True)
    rows = rows.unionByName(reached.join(labels, "node_id").select("cell", F.lit(ROLES["label"]).alias("role"), "node_id", "label"), allowMissingColumns=True)
    return rows.repartition(3 * parts, "cell"), links, left, parts


def _arrow_types(seeds: DataFrame, labels: DataFrame) -> tuple[pa.DataType, pa.DataType, str, str]:
    from pyspark.sql.pandas.types import to_arrow_type

    seed, label = seeds.schema["node_id"].dataType, labels.schema["label"].dataType
    return to_arrow_type(seed), to_arrow_type(label), seed.simpleString(), label.simpleString()


def all_reached(edges: DataFrame, seeds: DataFrame, depth: int, labels: DataFrame, reverse: bool = False, most_links: int = MOST_LINKS) -> DataFrame:
    """``seed, label, depth``: least depth of every label (labels: node_id, label) of a node within ``depth`` edges of each seed (node_id), seed left out."""
    rows, links, left, _ = _cells(edges, seeds, depth, reverse, labels, most_links)
    seed_type, label_type, seed, label = _arrow_types(seeds, labels)
    out = rows.groupBy("cell").applyInArrow(_all_reached(depth, seed_type, label_type), f"seed {seed}, label {label}, depth int")
    if left is not None:
        more = reach(links.select(F.col("node_id").alias("src_id"), F.col("to").alias("dst_id")), left, depth, labels=labels)
        out = out.unionByName(more.select("seed", "label", "depth"))
    return out


def nearest_reached(edges: DataFrame, seeds: DataFrame, depth: int, labels: DataFrame, most: int, reverse: bool = False, most_links: int = MOST_LINKS) -> DataFrame:
    """``seed, labels, depths``: the first ``most`` of ``all_reached`` for each seed that reaches any, by depth and label."""
    rows, links, left, _ = _cells(edges, seeds, depth, reverse, labels, most_links)
    seed_type, label_type, seed, label = _arrow_types(seeds, labels)
    out = rows.groupBy("cell").applyInArrow(_nearest(depth, most, seed_type, label_type), f"seed {seed}, labels array<{label}>, depths array<int>")
    if left is not None:
        more = reach(links.select(F.col("node_id").alias("src_id"), F.col("to").alias("dst_id")), left, depth, labels=labels, enough=most)
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "label"))
        more = more.withColumn("place", rank).where(F.col("place") <= most).groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("place", "label", "depth"))).alias("x"))
        out = out.unionByName(more.select("seed", F.col("x.label").alias("labels"), F.col("x.depth").alias("depths")))
    return out
