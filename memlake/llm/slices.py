"""Whole texts in slices, and questions from slices to shards of a key space.

Some operators ask for every place of a text how often a key occurs in the
whole corpus. A row for each place would make many times the input. Here a
slice (some MB of whole texts) asks each shard of the key space for its
distinct keys at once, as one sorted, delta-coded blob with the counts of the
slice; the shard adds up the slices and answers in the order of the question.
The slice makes its keys anew from its texts when the answers are there. Equal
keys of a slice are one entry, so a key with a third of all places is one
entry a slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame

from .common import written

#: Bytes of text from which on a slice is closed; a longer text is a slice of its own or the last of one.
SLICE_BYTES = 4 << 20
SLICE = "slice long, ids array<long>, flags array<boolean>, sizes array<long>, texts binary"
QUESTION = "kind int, shard int, slice long, keys binary, counts binary"
ANSWER = "slice long, kind int, shard int, answer binary"


def release() -> None:
    """Gives a worker's free memory back; workers stay for later tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def squeeze(values: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unsqueeze(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, without the low bits that none of them uses."""
    used = int(np.bitwise_or.reduce(keys, initial=np.uint64(0)))
    low = (used & -used).bit_length() - 1 if used else 0
    return bytes([low]) + squeeze(np.diff(keys >> np.uint64(low), prepend=np.uint64(0)))


def unsqueeze_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob[1:], np.uint64), dtype=np.uint64) << np.uint64(blob[0])


def sliced(docs: DataFrame, doc_id: Column, text: Column, flag: Column, name: str, most: int = SLICE_BYTES) -> DataFrame:
    """Rows SLICE of all rows of docs, written; a null text is empty. A slice's number is its partition's and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        ids, flags, texts = [], [], []

        def row() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(1).compress(b"".join(texts))
            arrays = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["slice", "ids", "flags", "sizes", "texts"])

        for batch in batches:
            for i, t, f in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ids.append(i.as_py()), texts.append(t.as_py() or b""), flags.append(f.as_py())
                size += len(texts[-1])
                if size >= most:
                    yield row()
                    number, size, ids, flags, texts = number + 1, 0, [], [], []
        if ids:
            yield row()
        release()

    rows = docs.select(doc_id.cast("long").alias("i"), text.cast("binary").alias("t"), flag.alias("f"))
    return written(rows.mapInArrow(run, SLICE), name)


def texts_of(sizes: list[int], blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob) if sizes else b""
    ends = np.cumsum(sizes).tolist()
    return [raw[e - n : e] for e, n in zip(ends, sizes, strict=True)]


def ask(slice_: int, kind: int, keys: np.ndarray, counts: np.ndarray | None, shards: int) -> list[tuple]:
    """Rows QUESTION for sorted distinct keys; the shard is set by the upper half of the key."""
    edges = (np.arange(1, shards, dtype=np.uint64) << np.uint64(32)) // np.uint64(shards)
    cuts = [0, *np.searchsorted(keys >> np.uint64(32), edges).tolist(), len(keys)]
    out = []
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            n = squeeze(counts[a:b].astype(np.uint32)) if counts is not None else None
            out.append((kind, k, slice_, squeeze_sorted(keys[a:b]), n))
    return out


def question_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "shard", "slice", "keys", "counts"])


def gathered(table: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Of a shard's questions in order: the slices, how many keys each has, all keys, and their counts (1 where none are given)."""
    table = table.sort_by("slice")
    keys = [unsqueeze_sorted(k) for k in table.column("keys").to_pylist()]
    counts = [np.ones(len(k), np.uint32) if c is None else unsqueeze(c, np.uint32) for k, c in zip(keys, table.column("counts").to_pylist(), strict=True)]
    return table.column("slice").to_pylist(), [len(k) for k in keys], np.concatenate(keys), np.concatenate(counts)


def answer_table(slices: list[int], kind: int, shard: int, blobs: list[bytes | None]) -> pa.Table:
    """Rows ANSWER; slices below 0 only teach and get none."""
    kept = [(s, b) for s, b in zip(slices, blobs, strict=True) if b is not None]
    return pa.table({"slice": pa.array([s for s, _ in kept], pa.int64()), "kind": pa.array([kind] * len(kept), pa.int32()), "shard": pa.array([shard] * len(kept), pa.int32()), "answer": pa.array([b for _, b in kept], pa.binary())})


def answers_of(table: pa.Table, kind: int) -> list[bytes]:
    """A slice's answers of one kind in the order of its shards, and so of its keys."""
    rows = sorted((s, b) for k, s, b in zip(table.column("kind").to_pylist(), table.column("shard").to_pylist(), table.column("answer").to_pylist(), strict=True) if k == kind)
    return [b for _, b in rows]
