"""MinHash near-dedup: banded universal minima, verified pairs, connected components.

1. Every whole text becomes its set of distinct word shingles, and the set its
   signature: the least values of PERMUTATIONS universal hash functions.
   Documents with the same set fall together first, so a group of copies is
   one representative from here on.
2. Signatures are cut into BANDS bands of ROWS minima; documents that share a
   band's key are candidates. A pair of similarity 0.75 shares none of the 40
   bands of 5 with probability 2e-5.
3. Candidates of a key are not paired with each other but with one member, the
   pivot. Pairs are checked by their signatures (8 bits a minimum), then by
   the full shingle sets, and the links found are joined into components by
   alternating large-star and small-star steps. Keys whose members are not in
   one component yet go on with other pivots; at last every member outside
   its key's largest component meets all members of other components. So no
   link between different components is missed, and the members that are
   linked already, however many, are never paired among themselves. Members
   of large keys meet in blocks that give back links only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, by_ids, keyed_join, numbered, without_rows, written
from .components import components

SHINGLE = 5
PERCENT = 75
BANDS = 40
ROWS = 5
PERMUTATIONS = BANDS * ROWS
#: Least share of equal 8-bit minima of a pair that goes to the full check: six standard deviations under 0.75.
SIGNATURE_SHARE = 0.57
PIVOT_TURNS = 2
#: Texts are hashed in blocks of about this many bytes, cut at white space.
BLOCK = 1 << 20
#: Members of keys for each task and file of the turns.
PART_ROWS = 1 << 14
#: Members of larger keys meet in blocks of BLOCK_DOCS by BLOCK_DOCS, not by a join.
SMALL_KEY = 16
BLOCK_DOCS = 256

_SEED = 0x6D656D6C
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _block_words(data: np.ndarray) -> np.ndarray:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    lengths = ends - starts
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(lengths.max()), _ODD))), dtype=np.uint64)
    at = np.flatnonzero(~space)
    within = at - np.repeat(starts, lengths)
    terms = (low[at].astype(np.uint64) + np.uint64(1)) * powers[within]
    sums = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1])))
    return _mix(sums ^ (lengths.astype(np.uint64) << np.uint64(48)))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each word of the text, A-Z lower-cased, in order; words end at ASCII white space."""
    raw = text.encode("utf-8")
    if len(raw) <= BLOCK:
        return _block_words(np.frombuffer(raw, np.uint8))
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        out.append(_block_words(np.frombuffer(raw[at:end], np.uint8)))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words; the whole sequence if there are fewer; empty without words."""
    words = word_hashes(text or "")
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(size, len(words))
    n = len(words) - width + 1
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total = total * _ODD + words[k : k + n]
    return np.unique(_mix(total))


def permutations(count: int = PERMUTATIONS, seed: int = _SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of a*x + b (mod 2**32) over the shingles, for each (a, b); 32 shingles at a time stay in cache."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 32):
        np.minimum(out, (x[at : at + 32, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.arange(1, bands + 1, dtype=np.uint64) * _ODD
    for k in range(rows):
        total = _mix(total * _ODD + sig.reshape(bands, rows)[:, k])
    return total.view(np.int64)


def _sketch(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(bands * rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, fp, keys, sigs = [], [], [], []
                for text in part.column(1):
                    shingles = shingle_set(text.as_py(), size)
                    n.append(len(shingles))
                    if not len(shingles):
                        fp.append(None), keys.append(None), sigs.append(None)
                        continue
                    sig = signature(shingles, a, b)
                    fp.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(sig, bands, rows))
                    sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["rid", "n_shingles", "fp", "keys", "sig"])

    return run


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), size).tobytes() for t in part.column(1)], pa.binary())], names=["rid", "shingles"])

    return run


def _close(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [float((np.frombuffer(x.as_py(), np.uint8) == np.frombuffer(y.as_py(), np.uint8)).mean()) >= share for x, y in zip(batch.column("sig_a"), batch.column("sig_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, n_a, b, n_b) whose set sizes allow the similarity, in order of id, each once."""
    fits = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return fits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    signature_share: float = SIGNATURE_SHARE,
) -> DataFrame:
    """One row for each row of docs: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| over
    their sets of distinct shingles (of fewer words than a shingle has: the
    whole sequence). ``component_id`` is the least id reachable over links.

    A null or empty text has no shingles, is linked with nothing and kept.
    Rows that repeat an id are one node with the links of all of them, and
    share its component. Rows with a null id are linked with nothing; their
    component_id is null and they are kept. An empty table gives no rows;
    other columns are not looked at.
    """
    plain = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "near-docs")
    out = _components_of(plain, shingle, percent, bands, rows, signature_share, True)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _components_of(plain: DataFrame, shingle: int, percent: int, bands: int, rows: int, signature_share: float, by_id: bool) -> DataFrame:
    """``ROW, doc_id, n_shingles, component, component_id`` of numbered rows (ROW, doc_id, text).

    ``component`` is the least row number reachable, ``component_id`` the least
    id. With ``by_id`` rows of one id are linked, and rows without an id with
    nothing.
    """
    schema = "rid long, n_shingles long, fp binary, keys array<long>, sig binary"
    sketches = written(plain.select(ROW, "text").mapInArrow(_sketch(bands, rows, shingle), schema), "near-sketch")
    ids = plain.select(F.col(ROW).alias("rid"), "doc_id")
    able = sketches.where("n_shingles > 0")
    if by_id:
        able = able.join(by_ids(ids, ids.where("doc_id is null").select("rid"), "rid", "left_semi"), "rid", "left_anti")
    first = written(able.groupBy("fp").agg(F.min("rid").alias("first"), F.count("*").alias("copies")), "near-first")
    copies = able.select("rid", "fp").join(first.where("copies > 1"), "fp").where("rid <> first").select("rid")
    reps = by_ids(able.select("rid", F.col("n_shingles").alias("n"), "keys", "sig"), copies, "rid", "left_anti").withColumnRenamed("rid", "doc_id")

    placed = reps.select(F.explode("keys").alias("key"), "doc_id", "n")
    # keys with several members, added up before the shuffle, and then their members by a join whose hot partitions are split
    shared = placed.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "n")).alias("p")).where("m > 1")
    members = keyed_join(placed, shared.select("key", F.col("p.doc_id").alias("p_id"), F.col("p.n").alias("p_n")), ["key"], "inner", "near-keys")
    members = written(members, "near-members")
    # tables of the turns have a row for each member at most: so many files, not one for each shuffle partition
    parts = max(1, -(-members.count() // PART_ROWS))
    kept_sets: list[DataFrame] = []

    def all_sets() -> DataFrame:
        """Full shingle sets of the documents that share a key."""
        if not kept_sets:
            texts = by_ids(plain.select(F.col(ROW).alias("doc_id"), "text"), members.select("doc_id"), "doc_id", "left_semi")
            kept_sets.append(written(texts.mapInArrow(_shingles(shingle), "rid long, shingles binary").withColumnRenamed("rid", "doc_id"), "near-sets"))
        return kept_sets[0]

    signatures = written(by_ids(reps.select("doc_id", "sig"), members.select("doc_id"), "doc_id", "left_semi"), "near-signatures")

    def verified(pairs: DataFrame, turn: str) -> DataFrame:
        near = pairs.join(signatures.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(signatures.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
        near = written(near.mapInArrow(_close(signature_share), "a long, b long").coalesce(parts), f"near-close-{turn}")
        sets = all_sets()
        full = near.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        return written(full.mapInArrow(_linked(percent), "a long, b long").coalesce(parts), f"near-links-{turn}")

    pairs = _sized(members.where("doc_id <> p_id").select(F.col("p_id").alias("a"), F.col("p_n").alias("n_a"), F.col("doc_id").alias("b"), F.col("n").alias("n_b")), percent)
    links, tested, labels, rest = None, None, None, None
    for turn in range(PIVOT_TURNS + 1):
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs.coalesce(parts), f"near-turn-{turn}")
        found = []
        if not pairs.isEmpty():
            tested = pairs if tested is None else tested.unionByName(pairs)
            found.append(verified(pairs, str(turn)))
        if turn == PIVOT_TURNS and rest.where(F.col("m") > SMALL_KEY).limit(1).count():
            found.append(written(_blocks(rest, all_sets(), signatures, percent, signature_share), "near-blocks"))
        for more in found:
            links = more if links is None else links.unionByName(more)
        if found:
            labels = written(components(links, f"near-cc-{turn}"), f"near-labels-{turn}")
        if turn == PIVOT_TURNS:
            break
        current = members.select("key", "doc_id", "n")
        if labels is not None:
            current = current.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id"))
        else:
            current = current.withColumn("label", F.col("doc_id"))
        current = written(current.select("key", "doc_id", "n", "label").coalesce(parts), f"near-current-{turn}")
        by_label = current.groupBy("key", "label").agg(F.count("*").alias("c"), F.min_by(F.struct("doc_id", "n"), F.xxhash64(F.lit(turn), "doc_id")).alias("p"), F.min(F.xxhash64(F.lit(turn), "doc_id")).alias("h"))
        open_keys = by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("most"), F.min_by("p", "h").alias("p"), F.min_by("label", "h").alias("p_label")).where("labels > 1")
        open_keys = written(open_keys.select("key", "m", "p", "p_label", F.col("most.label").alias("main"), (F.col("m") - F.col("most.c")).alias("outside")).coalesce(parts), f"near-open-{turn}")
        if open_keys.isEmpty():
            break
        rest = written(current.join(open_keys, "key").coalesce(parts), f"near-rest-{turn}")
        if turn < PIVOT_TURNS - 1:
            pairs = _sized(rest.where("label <> p_label").select(F.col("p.doc_id").alias("a"), F.col("p.n").alias("n_a"), F.col("doc_id").alias("b"), F.col("n").alias("n_b")), percent)
        else:
            pairs = _sized(_meetings(rest), percent)

    # back to rows: copies share their representative's component, and rows of one id each other's
    found = first.select("fp", F.col("first").alias("node"), "copies")
    if labels is not None:
        found = found.join(labels, "node", "left")
        found = found.select("fp", F.coalesce("component", "node").alias("component"), "copies", F.coalesce(F.col("component") != F.col("node"), F.lit(False)).alias("moved"))
    else:
        found = found.select("fp", F.col("node").alias("component"), "copies", F.lit(False).alias("moved"))
    found = found.where("copies > 1 or moved").select("fp", "component")
    joined = keyed_join(able.select("rid", "fp"), found, ["fp"], "inner", "near-found").select("rid", "component")
    joined = written(joined, "near-joined")
    if by_id:
        twice = ids.where("doc_id is not null").groupBy("doc_id").agg(F.min("rid").alias("component"), F.count("*").alias("c")).where("c > 1").select("doc_id", "component")
        twice = written(keyed_join(ids.where("doc_id is not null"), twice, ["doc_id"], "inner", "near-twice").select("rid", "component"), "near-same-id")
        if not twice.isEmpty():
            edges = joined.unionByName(twice).select(F.col("rid").alias("a"), F.col("component").alias("b"))
            joined = written(components(edges, "near-cc-id").select(F.col("node").alias("rid"), "component"), "near-joined-id")
    rows_ = sketches.select("rid", "n_shingles").join(ids, "rid").join(joined, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    rows_ = written(rows_, "near-rows")
    least = rows_.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1").select("component", "least")
    rows_ = keyed_join(rows_, least, ["component"], "left", "near-least")
    return rows_.select(F.col("rid").alias(ROW), "doc_id", "n_shingles", "component", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def _meetings(rest: DataFrame) -> DataFrame:
    """Pairs of one small key and different labels of which one at least is outside the key's main label."""
    few = rest.where(F.col("m") <= SMALL_KEY)
    left = few.where("label <> main").select("key", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"))
    right = few.select("key", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), "label")
    return left.join(right, "key").where("label_a <> label").select("a", "n_a", "b", "n_b")


def _blocks(rest: DataFrame, sets: DataFrame, sigs: DataFrame, percent: int, share: float) -> DataFrame:
    """Links ``a, b`` between the documents of large keys, found in blocks.

    Keys with the same main label are taken together. Their documents outside
    the label meet all their documents, BLOCK_DOCS of either side at a time;
    a block gives back one link for each two labels that it joins, not its
    pairs.
    """
    many = rest.where(F.col("m") > SMALL_KEY)
    right = many.select("main", "doc_id", "label").distinct()
    sizes = right.groupBy("main").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("n_right"), F.ceil(F.count_if(F.col("label") != F.col("main")) / BLOCK_DOCS).alias("n_left"))
    right = written(right.join(sizes, "main").join(sets, "doc_id").join(sigs, "doc_id"), "near-large")

    def dealt(side: DataFrame, own: str, other: str, mark: str) -> DataFrame:
        part = F.pmod(F.xxhash64("doc_id"), F.col(f"n_{own}")).cast("int").alias(own)
        spread = F.explode(F.sequence(F.lit(0), (F.col(f"n_{other}") - 1).cast("int"))).alias(other)
        return side.select("main", part, spread, F.struct("doc_id", "label", "shingles", "sig").alias(mark))

    left = dealt(right.where("label <> main"), "left", "right", "l").select("main", "left", "right", "l.*")
    right = dealt(right, "right", "left", "r").select("main", "left", "right", F.col("r.doc_id").alias("r_id"), F.col("r.label").alias("r_label"), F.col("r.shingles").alias("r_shingles"), F.col("r.sig").alias("r_sig"))

    def run(key, left_table, right_table):
        links = ([], [])
        if left_table.num_rows and right_table.num_rows:
            l_id, l_root, l_raw = (left_table.column(c).to_pylist() for c in ("doc_id", "label", "shingles"))
            r_id, r_root, r_raw = (right_table.column(c).to_pylist() for c in ("r_id", "r_label", "r_shingles"))
            l_set, r_set = [np.frombuffer(x, np.uint64) for x in l_raw], [np.frombuffer(x, np.uint64) for x in r_raw]
            l_sig = np.frombuffer(b"".join(left_table.column("sig").to_pylist()), np.uint8).reshape(len(l_id), -1)
            r_sig = np.frombuffer(b"".join(right_table.column("r_sig").to_pylist()), np.uint8).reshape(len(r_id), -1)
            n_right = np.array([len(x) for x in r_set])
            root: dict[int, int] = {}

            def find(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, own in enumerate(l_set):
                fits = 100 * np.minimum(len(own), n_right) >= percent * np.maximum(len(own), n_right)
                for j in np.flatnonzero(fits & ((l_sig[i] == r_sig).mean(axis=1) >= share)).tolist():
                    x, y = find(l_root[i]), find(r_root[j])
                    if x == y:
                        continue
                    both = len(np.intersect1d(own, r_set[j], assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(r_set[j]) - both):
                        root[max(x, y)] = min(x, y)
                        links[0].append(l_id[i]), links[1].append(r_id[j])
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    keys = ["main", "left", "right"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_keyed(run), "a long, b long")


def _keyed(f):
    def run(key, left, right):
        return f(key, left, right)

    return run


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, the one with the least id; all columns stay.

    Rows count as documents of their own, also those that repeat an id or have
    none (which come after all ids); of the same id the first row stays. A
    null or empty text is linked with nothing and stays.
    """
    rows = numbered(docs, "near-stage")
    plain = rows.select(ROW, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(_components_of(plain, shingle, percent, BANDS, ROWS, SIGNATURE_SHARE, False), "near-named")
    several = found.groupBy("component").agg(F.count("*").alias("c"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("stays")).where("c > 1")
    gone = keyed_join(found.select(ROW, "component"), several.select("component", F.col(f"stays.{ROW}").alias("stays")), ["component"], "inner", "near-stays")
    return without_rows(rows, gone.where(F.col(ROW) != F.col("stays")).select(ROW))
