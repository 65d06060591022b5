"""Byte-level BPE over a whole corpus by replaying merges on its distinct words.

A word is a match of the splitting pattern. Texts become sequences of word
numbers slice by slice, and each slice asks every shard of the words once for
its distinct words, as one compressed row. A shard has all slices' words that
hash to it. It lays the bytes of its distinct words out in a row, keeps for
every pair of neighbouring tokens that some rank joins the positions where it
stands, and replays the merges in rank order: all positions of a rank at once,
and only the pairs at their left and right are looked up again. Words that the
vocabulary has whole are one token, as in the usual encoders.

A shard answers each slice in the order of its question, so a word that stands
in a third of all places is asked once a slice. A slice puts the ids in the
order of its texts and decodes them. Sequences lie in a table bucketed by
slice, so answers come to them and they aren't shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.sources.scratch import shared_dir

from .common import BATCH_BYTES, BATCH_CONF, shuffle_parts
from .slices import release, squeeze, unsqueeze

#: Characters of text from which on a slice is closed; a longer text is the last of its slice.
SLICE_CHARS = 16 << 20
#: Bytes of all texts for each shard of the words.
SHARD_TEXT = 32 << 20


class Vocabulary:
    """Ranks of byte strings, and for every pair of tokens that a rank joins the rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        joins = [(left, right, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (left := self.ranks.get(token[:k])) is not None and (right := self.ranks.get(token[k:])) is not None]
        keys = np.array([(a << 32) | b for a, b, _ in joins] + [1 << 62], np.int64)  # the last stands for no pair
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for _, _, r in joins] + [-1], np.int64)[order]
        self.pairs = {(a, b): r for a, b, r in joins}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that joins each pair, -1 where none does."""
        keys = (left << 32) | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.tokens[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker, kept over its tasks."""
    return Vocabulary(path)


def merged_word(word: bytes, known: Vocabulary) -> list[int]:
    """Ids of one word: always the lowest rank next, of equal ranks the leftmost."""
    tokens: list[int | None] = known.of_byte[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, len(tokens) + 1)), list(range(-1, len(tokens) - 1))
    pairs = known.pairs
    heap = [(r, k) for k in range(len(tokens) - 1) if (r := pairs.get((tokens[k], tokens[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, at = heapq.heappop(heap)
        nxt = after[at]
        if tokens[at] is None or nxt >= len(tokens) or pairs.get((tokens[at], tokens[nxt])) != rank:
            continue
        tokens[at], tokens[nxt] = rank, None
        after[at] = end = after[nxt]
        if end < len(tokens):
            before[end] = at
            if (r := pairs.get((rank, tokens[end]))) is not None:
                heapq.heappush(heap, (r, at))
        if (start := before[at]) >= 0 and (r := pairs.get((tokens[start], rank))) is not None:
            heapq.heappush(heap, (r, start))
    return [t for t in tokens if t is not None]


def replay(words: list[bytes], known: Vocabulary) -> list[np.ndarray]:
    """Ids of each word, by merges over all of them in rank order.

    Positions lie in a row; ``after`` and ``before`` lead to the neighbouring
    token of the same word, or to -1. ``where`` has the positions at which a
    rank can join a token and the next, as they came up; one that no longer
    fits is passed over. Of overlapping positions the left one is taken.

    Should a merge bring up a pair of lower rank than its own, that word would
    have needed it first: such words are merged one by one.
    """
    whole = [known.ranks.get(w) for w in words]
    sizes = np.array([0 if r is not None else len(w) for w, r in zip(words, whole, strict=True)], np.int64)
    raw = np.frombuffer(b"".join(w for w, r in zip(words, whole, strict=True) if r is None), np.uint8)
    token = known.of_byte[raw]
    n = len(token)
    owner = np.repeat(np.arange(len(words)), sizes)
    inner = owner[:-1] == owner[1:] if n else np.zeros(0, bool)
    place = np.arange(n)
    after, before = np.full(n, -1), np.full(n, -1)
    after[:-1][inner], before[1:][inner] = place[1:][inner], place[:-1][inner]
    where: dict[int, list[np.ndarray]] = defaultdict(list)
    due: list[int] = []

    def note(at: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        rank, at = rank[order], at[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, some in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
            if r not in where:
                heapq.heappush(due, r)
            where[r].append(some)

    def look(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = known.joined(token[at], token[after[at]])
        found = rank >= 0
        return at[found], rank[found]

    at, rank = look(place[after >= 0])
    if len(at):
        note(at, rank)
    odd: set[int] = set()
    while due:
        now = heapq.heappop(due)
        at = np.unique(np.concatenate(where.pop(now)))
        at = at[(token[at] >= 0) & (after[at] >= 0)]
        at = at[known.joined(token[at], token[after[at]]) == now]
        if not len(at):
            continue
        # in a run of positions each next to the last, every other one from the left
        starts = np.concatenate(([True], after[at[:-1]] != at[1:]))
        run_start = np.flatnonzero(starts)
        nth = np.arange(len(at)) - np.repeat(run_start, np.diff(np.concatenate((run_start, [len(at)]))))
        at = at[nth % 2 == 0]
        gone = after[at]
        ends = after[gone]
        inside = ends >= 0
        # what a merge sees on its right before the next position of this rank is merged
        seen = known.joined(np.full(inside.sum(), now), token[ends[inside]])
        odd.update(owner[at[inside][(seen >= 0) & (seen < now)]].tolist())
        token[at], token[gone] = now, -1
        after[at] = ends
        before[ends[inside]] = at[inside]
        touched = np.unique(np.concatenate((at[inside], before[at][before[at] >= 0])))
        touched, rank = look(touched)
        if len(touched):
            odd.update(owner[touched[rank < now]].tolist())
            note(touched[rank > now], rank[rank > now]) if (rank > now).any() else None
    left = token >= 0
    ids, ends = token[left], np.cumsum(np.bincount(owner[left], minlength=len(words)))
    cut = np.split(ids, ends[:-1]) if len(words) else []
    return [np.array([r]) if r is not None else np.array(merged_word(w, known)) if k in odd else c for k, (w, r, c) in enumerate(zip(words, whole, cut, strict=True))]


class Numbers(dict):
    """The numbers of a slice's words in the order in which they come up."""

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        return out


PARTS = "slice long, shard int, ids array<long>, sizes array<long>, places binary, lengths binary, words binary"
KINDS = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
ANSWER = "slice long, shard int, lengths binary, tokens binary"


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """df written to the shared folder in buckets by ``column`` and read from there, so that what needs the rows of a value together finds them so.

    Only a table can be read by buckets; its entry goes at once, its files stay.
    """
    spark = df.sparkSession
    key = f"memlake_{name}_{uuid.uuid4().hex}"
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    df.write.bucketBy(shuffle_parts(spark), column).option("compression", "zstd").option("path", f"{shared_dir(spark)}/memlake/{key}").saveAsTable(key)
    out = spark.table(key)
    spark.sql(f"DROP TABLE {key}")
    return out


def split_texts(docs: DataFrame, pattern: str, shards: int, id_col: str, text_col: str, most: int = SLICE_CHARS) -> DataFrame:
    """Rows PARTS: slices of whole texts as word numbers (``ids, sizes, places``), and their distinct words by shard (``shard, lengths, words``).

    A slice numbers its words shard by shard, so its answers in the order of shards are in the order of numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        number, size = TaskContext.get().partitionId() << 32, 0
        ids, sizes, places, numbers = [], [], [], Numbers()

        def closed() -> pa.RecordBatch:
            words = [w.encode() for w in numbers]
            shard = np.array([zlib.crc32(w) % shards for w in words], np.int64)
            order = np.argsort(shard, kind="stable")
            renumbered = np.empty(len(words), np.uint32)
            renumbered[order] = np.arange(len(words), dtype=np.uint32)
            rows = [(number, None, ids, sizes, squeeze(renumbered[np.concatenate(places)]), None, None)]
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in np.unique(shard).tolist():
                own = [words[i] for i in order[ends[k] : ends[k + 1]].tolist()]
                rows.append((number, k, None, None, None, squeeze(np.array([len(w) for w in own], np.uint32)), zstandard.ZstdCompressor(3).compress(b"".join(own))))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=["slice", "shard", "ids", "sizes", "places", "lengths", "words"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = t.as_py() or ""
                found = find(text)
                ids.append(i.as_py()), sizes.append(len(found)), places.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                size += len(text)
                if size >= most:
                    yield closed()
                    number, size, ids, sizes, places, numbers = number + 1, 0, [], [], [], Numbers()
        if ids:
            yield closed()
        release()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, PARTS)


def answered(questions: DataFrame, path: str) -> DataFrame:
    """Rows ANSWER: the ids of the words of each question, shard by shard over all slices."""

    def answer(key, table: pa.Table) -> pa.Table:
        known = vocabulary(path)
        number: dict[bytes, int] = {}
        asked: list[np.ndarray] = []
        for lengths, blob in zip(table.column("lengths").to_pylist(), table.column("words").to_pylist(), strict=True):
            raw, ends = zstandard.ZstdDecompressor().decompress(blob), np.cumsum(unsqueeze(lengths, np.uint32), dtype=np.int64).tolist()
            asked.append(np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip([0, *ends], ends, strict=False)], np.int64))
        ids = replay(list(number), known)
        size = np.array([len(x) for x in ids], np.int64)
        flat, start = np.concatenate(ids).astype(np.uint32), np.cumsum(size) - size
        out = []
        for words in asked:
            n = size[words]
            at = np.repeat(start[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((squeeze(n.astype(np.uint32)), squeeze(flat[at])))
        release()
        return pa.table({"slice": table.column("slice"), "shard": table.column("shard"), "lengths": pa.array([x for x, _ in out], pa.binary()), "tokens": pa.array([x for _, x in out], pa.binary())})

    return questions.groupBy("shard").applyInArrow(lambda key, table: answer(key, table), ANSWER)


ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, slice_chars: int = SLICE_CHARS, shard_text: int = SHARD_TEXT) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every whole text.

    ``path`` is a file of ranks (a base64 token and its rank a line) that has
    all single bytes; workers read it. Each match of ``pattern`` is encoded on
    its own: as one token if the ranks have it, else by merging the pair of
    lowest rank, the leftmost first, until none is left. No text is a special
    token. ``ids`` are little-endian unsigned 32-bit numbers, zstd-compressed
    (null without ``with_ids``); ``ids_sha256`` is of the decimal ids joined by
    one space, ``decoded_sha256`` of the bytes that the ids decode to.

    Null and empty texts have no tokens. Rows that repeat an id or have none
    are texts of their own; an empty table gives no rows; other columns are
    not looked at. A text is never cut, however long.

    ``slice_chars`` and ``shard_text`` bound what a task holds; the rows between
    stages are slices times shards, so raise both with the corpus.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    parts = bucketed(split_texts(docs, pattern, max(1, -(-size // shard_text)), id_col, text_col, slice_chars), "bpe", "slice")
    answers = answered(parts.where("shard is not null").select("slice", "shard", "lengths", "words"), path)
    texts = parts.where("shard is null").select("slice", F.col("ids").alias("docs"), "sizes", "places")

    def put(_key, slices: pa.Table, found: pa.Table) -> pa.Table:
        known, pack = vocabulary(path), zstandard.ZstdCompressor(1).compress
        found = found.sort_by("shard")
        ids, shown, decoded = [], [], []
        for lengths, tokens in zip(found.column("lengths").to_pylist(), found.column("tokens").to_pylist(), strict=True):
            flat, ends = unsqueeze(tokens, np.uint32), np.cumsum(unsqueeze(lengths, np.uint32), dtype=np.int64).tolist()
            digits, raw = [b"%d" % i for i in flat.tolist()], [known.tokens[i] for i in flat.tolist()]
            for start, end in zip([0, *ends], ends, strict=False):
                ids.append(flat[start:end]), shown.append(b" ".join(digits[start:end])), decoded.append(b"".join(raw[start:end]))
        size = np.array([len(x) for x in ids], np.int64)
        out: list[tuple] = []
        for row in slices.to_pylist():
            places, at = unsqueeze(row["places"], np.uint32), 0
            for doc, words in zip(row["docs"], row["sizes"], strict=True):
                own = places[at : at + words]
                at += words
                each = own.tolist()
                blob = pack(b"".join([ids[k].tobytes() for k in each])) if with_ids else None
                out.append((doc, int(size[own].sum()), hashlib.sha256(b" ".join([shown[k] for k in each])).hexdigest(), hashlib.sha256(b"".join([decoded[k] for k in each])).hexdigest(), blob))
        release()
        names, kinds = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(lambda key, a, b: put(key, a, b), ENCODED)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of ids as ``bpe_encode`` gives them; bytes that aren't UTF-8 show as U+FFFD, null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpack = vocabulary(path), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [None if b is None else known.decode(np.frombuffer(unpack(b), "<u4")).decode("utf-8", "replace") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
