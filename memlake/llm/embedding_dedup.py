"""Embedding near-dedup by product quantisation.

Vectors are scaled to length 1, so a cosine of at least c means a Euclidean
distance of at most sqrt(2 - 2c). A coarse codebook deals them to inverted
lists, and what is left of a vector after its centroid is coded subspace by
subspace. Both codebooks are fitted on a bounded sample; every vector is
indexed. Each vector is also a query:

* Probes: a list is probed unless the triangle inequality (the distance to the
  centroid less the list's radius) or the bisecting hyperplane between two
  centroids shows that it can hold no vector within the distance. So the
  probes are sufficient for every link, not a fixed number.
* Scan: asymmetric distances of the query to the coded entries come from
  look-up tables. An entry whose coded distance less its own coding error
  exceeds the bound is no link; the error is stored with the entry.
* Rerank: what is left is compared by exact cosine in double precision.

Equal vectors are one entry with a count. A list is cut into chunks of
bounded size, on both sides, so no task holds a whole list. A block sends on
the numbers of links and a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, keyed_join, numbered, written
from .components import components

COSINE = 0.93
#: Rows of the sample on which codebooks are fitted, at most twice as many.
FIT_ROWS = 20_000
#: Entries a list is meant to have; the number of lists follows the number of vectors, with LIST_SAMPLE rows of the sample for each.
LIST_ROWS = 4096
LIST_SAMPLE = 4
SUBSPACES = 16
CODES = 64
#: Entries and queries of a block.
CHUNK = 1024
SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, turns: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids of the rows of x by Lloyd's steps from a seeded choice of rows; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float64).copy()
    for _ in range(turns):
        near = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return c


class Codebook:
    """Coarse centroids and residual subspace centroids."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES):
        self.width = sample.shape[1]
        self.coarse = kmeans(sample, lists)
        self.parts = [p for p in np.array_split(np.arange(self.width), min(subspaces, self.width)) if len(p)]
        residual = sample - self.coarse[self.nearest(sample)[0]]
        self.fine = [kmeans(residual[:, p], min(codes, max(1, len(sample)))) for p in self.parts]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x)
        near = d.argmin(1)
        return near, d[np.arange(len(x)), near]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and each vector's distance from what its codes stand for."""
        residual = x - self.coarse[lists]
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        error = np.zeros(len(x))
        for k, (p, c) in enumerate(zip(self.parts, self.fine, strict=True)):
            d = ((residual[:, p] ** 2).sum(1)[:, None] - 2 * residual[:, p] @ c.T + (c**2).sum(1)).clip(0)
            codes[:, k] = d.argmin(1)
            error += d[np.arange(len(x)), codes[:, k]]
        return codes, np.sqrt(error)

    def coded_distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances, queries x entries of list ``at``: sums over look-up tables by subspace."""
        residual = queries - self.coarse[at]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for k, (p, c) in enumerate(zip(self.parts, self.fine, strict=True)):
            table = ((residual[:, p] ** 2).sum(1)[:, None] - 2 * residual[:, p] @ c.T + (c**2).sum(1)).astype(np.float32)
            total += table[:, codes[:, k]]
        return np.sqrt(np.maximum(total, 0))

    def probes(self, x: np.ndarray, radius: np.ndarray, bound: float) -> list[np.ndarray]:
        """Lists that can hold a vector within ``bound`` of each row of x; radius: of each list, negative where it is empty."""
        d = self.distances(x)
        near = d.argmin(1)
        own = d[np.arange(len(x)), near]
        lists, at = np.unique(near, return_inverse=True)
        gaps = self.distances(self.coarse[lists])
        gaps[np.arange(len(lists)), lists] = np.inf
        plane = (d**2 - (own**2)[:, None]) / (2 * np.where(gaps > 0, gaps, np.inf)[at])
        plane[np.arange(len(x)), near] = 0
        open_ = (radius >= 0) & (d - radius <= bound + SLACK) & (plane <= bound + SLACK)
        return [np.flatnonzero(row) for row in open_]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def embedding_near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    fit_rows: int = FIT_ROWS,
    list_rows: int = LIST_ROWS,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row for each row of vectors: ``vec_id, n_links, component_id, kept``.

    Two vectors are linked if their labels are equal and not null and their
    cosine in double precision is at least ``cosine``. Vectors that are null,
    empty, zero or hold null or non-finite components are linked with nothing;
    vectors of different lengths are never linked (each length has its own
    codebook). ``n_links`` counts the other rows linked directly,
    ``component_id`` is the least id reachable, itself included.

    Rows that repeat an id count as vectors of their own in ``n_links`` and
    share the component; a null id has a null component, is linked with
    nothing and kept. An empty table gives no rows; other columns are not
    looked at.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    usable = finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = written(plain.select("vec_id", F.when(usable, F.xxhash64("v", "label")).alias("h"), F.when(usable, F.col("v")).alias("v"), F.when(usable, F.col("label")).alias("label")), "pq-rows")
    able = rows.where("v is not null")
    distinct = able.groupBy("h", "v", "label").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # a vector goes by a number of its own: ids can repeat with other vectors
    distinct = numbered(distinct.withColumn("width", F.size("v")), "pq-distinct").withColumnRenamed(ROW, "rep")
    sizes = distinct.groupBy("width").count().collect()  # one row for each length of vectors

    counts, forests = [], []
    for width, n in sizes:
        own = distinct.where(F.col("width") == width)
        own_counts, own_forest = _links(own, width, n, cosine, fit_rows, list_rows, chunk)
        counts.append(own_counts)
        forests.append(own_forest)
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links, forest = counts[0], forests[0]
    for c, f in zip(counts[1:], forests[1:], strict=True):
        links, forest = links.unionByName(c), forest.unionByName(f)
    # rows of one id share a component
    ids = keyed_join(able.select("vec_id", "h", "v", "label"), distinct.select("h", "v", "label", "rep"), ["h", "v", "label"], "inner", "pq-ids").select("vec_id", "rep")
    ids = written(ids, "pq-rows-ids")
    twice = ids.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("vec_id", "a")
    same = keyed_join(ids, twice, ["vec_id"], "inner", "pq-twice").where("a <> rep").select("a", F.col("rep").alias("b"))
    found = components(forest.unionByName(same), "pq").withColumnRenamed("node", "rep")
    named = distinct.select("h", "v", "label", "rep", "least", "copies").join(links, "rep", "left").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = written(named.withColumn("n_links", F.coalesce("linked", F.lit(0)) + F.col("copies") - 1), "pq-linked")
    firsts = named.groupBy("component").agg(F.min("least").alias("first"), F.sum("copies").alias("rows")).where("rows > 1").select("component", "first")
    named = keyed_join(named, firsts, ["component"], "inner", "pq-firsts").select("h", "v", "label", "n_links", F.col("first").alias("component"))
    out = keyed_join(rows, named, ["h", "v", "label"], "left", "pq-named")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(own: DataFrame, width: int, n: int, cosine: float, fit_rows: int, list_rows: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Numbers of linked rows by representative (``rep, linked``) and forest edges (``a, b``)."""
    spark = own.sparkSession
    share = min(1.0, fit_rows / n)
    taken = own.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).select("v").limit(2 * fit_rows).collect()
    sample = _unit(np.array([r[0] for r in taken] or [[1.0] + [0.0] * (width - 1)], dtype=np.float64))
    lists = max(1, min(n // list_rows, len(sample) // LIST_SAMPLE))
    book = Codebook(sample, lists)
    shared = spark.sparkContext.broadcast(book)  # lists + subspaces * codes centroids
    bound = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("v"), width))
            near, d = b.nearest(x)
            codes, error = b.encode(x, near)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), batch.column("label"), batch.column("v"), pa.array(near, pa.int32()), pa.array(d, pa.float64()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float64())],
                names=["rep", "copies", "label", "v", "list", "far", "codes", "error"],
            )

    kind = own.schema["label"].dataType.simpleString()
    numbers = own.schema["v"].dataType.simpleString()
    indexed = written(own.select("rep", "copies", "label", "v").mapInArrow(index, f"rep long, copies long, label {kind}, v {numbers}, list int, far double, codes binary, error double"), "pq-index")
    # label x list: the number of entries and the radius; lists are bounded, labels are few
    shape = indexed.groupBy("list").agg(F.max("far").alias("r")).collect()
    radius = np.full(lists, -1.0)
    for r in shape:
        radius[r["list"]] = r["r"]
    full = indexed.groupBy("label", "list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = b.probes(_unit(_matrix(part.column("v"), width)), radius, bound)
                take = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(take)), part.column("label").take(pa.array(take)), pa.array(np.concatenate(found) if found else [], pa.int32())], names=["rep", "label", "list"])

    probes = indexed.select("rep", "label", "v").mapInArrow(probe, f"rep long, label {kind}, list int")
    probes = written(probes.join(full.withColumnRenamed("chunks", "n_entry"), ["label", "list"]), "pq-probes")
    asked = probes.groupBy("label", "list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n_query"))
    part = F.pmod(F.xxhash64("rep"), F.col("n_entry")).cast("int")
    entries = indexed.join(full.withColumnRenamed("chunks", "n_entry"), ["label", "list"]).join(asked, ["label", "list"])
    entries = entries.withColumn("e", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n_query") - 1))).select("label", "list", "e", "q", F.col("rep").alias("e_rep"), "copies", F.col("v").alias("e_v"), "codes", "error")
    queries = probes.join(asked, ["label", "list"]).withColumn("q", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n_query")).cast("int"))
    queries = queries.join(indexed.select("rep", "v"), "rep").withColumn("e", F.explode(F.sequence(F.lit(0), F.col("n_entry") - 1))).select("label", "list", "e", "q", "rep", "v")

    def scan(key, asked_table, entry_table):
        out = {"rep": [], "linked": [], "other": []}
        if asked_table.num_rows and entry_table.num_rows:
            b, at = shared.value, key[1].as_py()
            q_id, e_id = asked_table.column("rep").to_numpy(), entry_table.column("e_rep").to_numpy()
            q_raw, e_raw = _matrix(asked_table.column("v"), width), _matrix(entry_table.column("e_v"), width)
            q, e = _unit(q_raw), _unit(e_raw)
            codes = np.frombuffer(b"".join(entry_table.column("codes").to_pylist()), np.uint8).reshape(len(e_id), -1)
            error, copies = entry_table.column("error").to_numpy(), entry_table.column("copies").to_numpy()
            close = b.coded_distances(q, at, codes) <= bound + error + 1e-3  # look-up tables are float32
            i, j = np.nonzero(close & (q_id[:, None] != e_id[None]))
            dots = np.concatenate([np.einsum("ij,ij->i", q_raw[i[k : k + 65536]], e_raw[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
            real = dots / (np.linalg.norm(q_raw, axis=1)[i] * np.linalg.norm(e_raw, axis=1)[j]) >= cosine
            i, j = i[real], j[real]
            linked = np.zeros(len(q_id), np.int64)
            np.add.at(linked, i, copies[j])
            for k in np.flatnonzero(linked).tolist():
                out["rep"].append(int(q_id[k])), out["linked"].append(int(linked[k])), out["other"].append(None)
            ids = np.unique(np.concatenate((q_id, e_id)))
            left, right = np.searchsorted(ids, q_id[i]), np.searchsorted(ids, e_id[j])
            for x, y in _forest(len(ids), left, right):
                out["rep"].append(int(ids[x])), out["linked"].append(0), out["other"].append(int(ids[y]))
        return pa.table({"rep": pa.array(out["rep"], pa.int64()), "linked": pa.array(out["linked"], pa.int64()), "other": pa.array(out["other"], pa.int64())})

    keys = ["label", "list", "e", "q"]
    found = written(queries.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(_keyed(scan), "rep long, linked long, other long"), "pq-found")
    counts = found.where("linked > 0").groupBy("rep").agg(F.sum("linked").alias("linked"))
    return counts, found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct()


def _keyed(scan):
    def run(key, left, right):
        return scan(key, left, right)

    return run
