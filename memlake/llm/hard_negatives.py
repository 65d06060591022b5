"""Hard-negative mining with a vector-approximation file.

Vectors become integers, so scores are exact. Every dimension is cut into
cells at the quantiles of a bounded sample, and two for what lies beyond it,
whose ends are taken from all rows; so bounds hold for all of them. The approximation of a
vector is a byte a dimension. For an anchor, each cell of each dimension gives
the least and the greatest product with the anchor's component, a table; a
row's lower and upper score bounds are sums of look-ups by its bytes. Only rows
whose bounds leave open that they are among the best in a window of scores are
scored exactly.

Anchors are a stated set of queries. Blocks of anchors meet stripes of rows,
both of bounded size: of the same label for the positives, of any for the
negatives. A hot label has more stripes, not larger ones. A block sends on an
anchor's best rows of the stripe, not its scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, keyed_join, numbered, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score is between these percents of the positive's.
LOW, HIGH = 30, 90
#: Rows of the sample that cuts dimensions into cells, at most twice as many.
FIT_ROWS = 20_000
CELLS = 64
#: Anchors of a block and rows of a stripe, about.
BLOCK_ANCHORS = 2048
STRIPE_ROWS = 8192
#: Anchors whose bounds a task holds at once.
ANCHORS_AT_ONCE = 16
#: Sum of a vector's squared integers from which on 100 scores might not fit a long.
MOST_SQUARES = 2.0**50


@dataclass(frozen=True)
class Cells:
    """Cells of each dimension: inner edges, and the least and greatest integer that a row has there."""

    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int = CELLS) -> Cells:
        edges = np.quantile(sample, np.arange(cells + 1) / cells, axis=0, method="lower").T.astype(np.int64)
        edges[:, -1] += 1  # the two outer cells have only rows beyond the sample, so a row far out widens no other row's bounds
        # cell k holds edges[k - 1] <= y < edges[k]
        low = np.concatenate((least[:, None], np.maximum(edges, least[:, None])), axis=1)
        high = np.concatenate((np.minimum(edges - 1, most[:, None]), most[:, None]), axis=1)
        return cls(edges, low, np.maximum(low, high))

    def codes(self, y: np.ndarray) -> np.ndarray:
        """A byte for each dimension of each row, dimension by dimension."""
        return np.stack([np.searchsorted(e, y[:, d], side="right").astype(np.uint8) for d, e in enumerate(self.edges)])

    def bounds(self, anchors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, anchors x rows."""
        lower = np.zeros((codes.shape[1], len(anchors)), np.int64)
        upper = np.zeros_like(lower)
        for d, code in enumerate(codes):
            a, b = np.outer(self.low[d], anchors[:, d]), np.outer(self.high[d], anchors[:, d])
            lower += np.minimum(a, b)[code]
            upper += np.maximum(a, b)[code]
        return lower.T, upper.T


def best_in_windows(anchor: np.ndarray, y: np.ndarray, ids: np.ndarray, allowed: np.ndarray, lower: np.ndarray, upper: np.ndarray, windows: list[tuple[int, int]], most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the rows that are among the ``most`` best of any window, and how many rows were scored.

    A row may be in a window if its bounds overlap it, and surely is if they lie within.
    Beyond the ``most`` greatest lower bounds of the sure ones, a row whose upper bound is less isn't among the best.
    """
    open_ = np.zeros(len(y), bool)
    for lo, hi in windows:
        maybe = allowed & (upper >= lo) & (lower <= hi)
        sure = lower[maybe & (lower >= lo) & (upper <= hi)]
        if len(sure) >= most:
            maybe &= upper >= np.partition(sure, -most)[-most]
        open_ |= maybe
    at = np.flatnonzero(open_)
    score = y[at] @ anchor
    kept = np.zeros(len(at), bool)
    order = np.lexsort((ids[at], -score))
    for lo, hi in windows:
        inside = order[(score[order] >= lo) & (score[order] <= hi)]
        kept[inside[:most]] = True
    return at[kept], score[kept], len(at)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``vec_id, label, y``: the rows that take part, each component x as floor(scale * x)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0**40))
    y = F.transform("v", lambda x: F.floor(F.when(F.abs(x.cast("double")) < 2.0**40, x.cast("double") * scale)))
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    plain = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    squares = F.aggregate("y", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return plain.select("vec_id", "label", y.alias("y")).where(squares < MOST_SQUARES)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def fitted_cells(rows: DataFrame, n: int, width: int, fit_rows: int = FIT_ROWS) -> Cells:
    """Cells cut on a sample; their ends cover all rows."""
    share = int(min(1.0, fit_rows / n) * (1 << 30)) + 1
    taken = rows.where(F.pmod(F.xxhash64(ROW), F.lit(1 << 30)) < share).select("y").limit(2 * fit_rows).collect()
    ends = rows.select(F.posexplode("y").alias("d", "x")).groupBy("d").agg(F.min("x").alias("least"), F.max("x").alias("most")).orderBy("d").collect()  # a row a dimension
    least, most = (np.array([r[k] for r in ends], np.int64) for k in ("least", "most"))
    sample = np.array([r["y"] for r in taken], np.int64).reshape(-1, width) if taken else least[None]
    return Cells.fit(sample, least, most)


def dealt(anchors: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Each block ``b`` of anchors beside each stripe ``s`` of rows, of the same ``keys``; n_b and n_s are columns of both sides."""
    left = anchors.withColumn("b", F.pmod(F.xxhash64(ROW, F.lit(1)), F.col("n_b")).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n_s") - 1)))
    right = rows.withColumn("s", F.pmod(F.xxhash64(ROW), F.col("n_s")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    return left.drop("n_b", "n_s"), right.drop("n_b", "n_s"), [*keys, "b", "s"]


FOUND = "anchor long, vec_id long, score long"


def searched(left: DataFrame, right: DataFrame, by: list[str], shared: Broadcast, most: int, same: bool) -> DataFrame:
    """Best rows (FOUND) of each anchor in each stripe: of its label, but itself, or (same: False) of the others within its ``windows``."""

    def search(_key, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            cells: Cells = shared.value
            y, ids, places = _matrix(rows.column("y"), len(cells.low)), rows.column("vec_id").to_numpy(), rows.column(ROW).to_numpy()
            codes = np.ascontiguousarray(np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1).T)
            a, own = _matrix(anchors.column("y"), len(cells.low)), anchors.column(ROW).to_numpy()
            labels = pa.chunked_array([*anchors.column("label").chunks, *rows.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            of_anchor, of_row = labels[: len(a)], labels[len(a) :]
            windows = None if same else anchors.column("windows").to_pylist()
            for at in range(0, len(a), ANCHORS_AT_ONCE):
                lower, upper = cells.bounds(a[at : at + ANCHORS_AT_ONCE], codes)
                for i, (lo, hi) in enumerate(zip(lower, upper, strict=True), at):
                    allowed = (of_row == of_anchor[i]) & (places != own[i]) if same else of_row != of_anchor[i]
                    spans = [(int(lo.min()), int(hi.max()))] if same else [(w["lo"], w["hi"]) for w in windows[i]]
                    found, score, _ = best_in_windows(a[i], y, ids, allowed, lo, hi, spans, most)
                    out.append((np.full(len(found), own[i]), ids[found], score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip(("anchor", "vec_id", "score"), columns, strict=True)})

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda key, x, z: search(key, x, z), FOUND)


def floor_percent(column: Column) -> Column:
    """floor(column / 100) of a long, exactly."""
    return F.call_function("div", column - F.pmod(column, F.lit(100)), F.lit(100))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    fit_rows: int = FIT_ROWS,
    block: int = BLOCK_ANCHORS,
    stripe: int = STRIPE_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows for which ``anchors`` (over ``vec_id`` and ``label``) holds.

    A row's score is its integer inner product with the anchor. An anchor's
    positives are its ``positives`` best other rows of the same label. For
    each of them come the ``negatives`` best rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``,
    ranked from 1. Higher scores come first, then smaller ids. Where fewer rows
    qualify, all are returned: a positive without a negative, and an anchor
    without a positive, gives no row.

    Rows with a null id, label or vector, an empty vector, a null or
    non-finite component, or squares that sum to 2**50 or more (scores must
    be exact) take no part. Neither do vectors whose length isn't the most
    frequent one (of equally frequent ones the greatest): they have no inner
    product with the others. Rows that repeat an id are rows of their own,
    and may be each other's positives. An empty table gives no rows; other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    plain = integers(vectors, id_col, vector_col, label_col, scale)
    rows = numbered(plain.withColumn("width", F.size("y")), "va-rows")
    shape = rows.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    if shape is None:
        return rows.selectExpr("vec_id as anchor_id", "vec_id as positive_id", "0 as rank", "vec_id as negative_id", "0L as positive_score", "0L as negative_score")
    width, n = shape
    rows = rows.where(F.col("width") == width).drop("width")
    cells = fitted_cells(rows, n, width, fit_rows)
    shared = spark.sparkContext.broadcast(cells)  # dimensions x cells

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = shared.value.codes(_matrix(batch.column("y"), width)).T
            yield batch.append_column("codes", pa.array([c.tobytes() for c in codes], pa.binary()))

    kind = rows.schema["label"].dataType.simpleString()
    filed = written(rows.select(ROW, "vec_id", "label", "y").mapInArrow(encode, f"{ROW} long, vec_id long, label {kind}, y array<long>, codes binary"), "va-file")
    asked = written(filed.where(anchors), "va-anchors")

    def parts(t: DataFrame, most: int, name: str) -> DataFrame:
        return t.groupBy("label").agg(F.ceil(F.count("*") / most).cast("int").alias(name))

    grid = written(parts(asked, block, "n_b").join(parts(filed, stripe, "n_s"), "label"), "va-grid")
    left, right = (keyed_join(t, grid, ["label"], "inner", "va-grid") for t in (asked.drop("codes"), filed))
    found = searched(*dealt(left, right, ["label"]), shared, positives, same=True)
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
    lists = found.withColumn("place", rank).where(F.col("place") <= positives).select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    lists = lists.withColumn("lo", -floor_percent(-low * F.col("positive_score"))).withColumn("hi", floor_percent(high * F.col("positive_score")))
    lists = written(lists.where("lo <= hi"), "va-positives")

    of_anchor = lists.groupBy("anchor").agg(F.collect_set(F.struct("lo", "hi")).alias("windows")).withColumnRenamed("anchor", ROW)  # at most as many as positives
    left = written(asked.drop("codes").join(of_anchor, ROW), "va-windows")
    counts = {"n_b": left.count() / block, "n_s": n / stripe}
    left, right = (t.withColumns({k: F.lit(max(1, math.ceil(c))) for k, c in counts.items()}) for t in (left, filed))
    found = searched(*dealt(left, right, []), shared, negatives, same=False)
    inside = (F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi"))
    pairs = written(found, "va-found").join(lists, "anchor").where(inside)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id"))
    ids = asked.select(F.col(ROW).alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = pairs.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumnRenamed("vec_id", "negative_id").join(ids, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
